"""Rule tables.  These are data, not code: the span jobs read them.

FIXED VALUES -- these must equal the analysed language's definitions and the
output formats the editor protocol expects; they are stated here plainly and in
their natural order.
"""

# --- FIXED VALUES: Go keywords (language specification order) -------------
GO_KEYWORDS = [
    "break", "case", "chan", "const", "continue", "default", "defer", "else",
    "fallthrough", "for", "func", "go", "goto", "if", "import", "interface",
    "map", "package", "range", "return", "select", "struct", "switch", "type",
    "var",
]

# --- FIXED VALUES: predeclared identifiers (kind, name, type descriptor) ---
BUILTINS = [
    ("TYPE", "int", "int"), ("TYPE", "int8", "int8"), ("TYPE", "int16", "int16"),
    ("TYPE", "int32", "int32"), ("TYPE", "int64", "int64"),
    ("TYPE", "uint", "uint"), ("TYPE", "uint8", "uint8"), ("TYPE", "uint16", "uint16"),
    ("TYPE", "uint32", "uint32"), ("TYPE", "uint64", "uint64"),
    ("TYPE", "float32", "float32"), ("TYPE", "float64", "float64"),
    ("TYPE", "complex64", "complex64"), ("TYPE", "complex128", "complex128"),
    ("TYPE", "uintptr", "uint"), ("TYPE", "bool", "bool"), ("TYPE", "byte", "any"),
    ("TYPE", "rune", "any"), ("TYPE", "string", "string"),
    ("CONST", "nil", "any"), ("CONST", "iota", "int"), ("CONST", "true", "bool"),
    ("CONST", "false", "bool"),
    ("FUNC", "append", "append"), ("FUNC", "make", "make"), ("FUNC", "new", "new"),
    ("FUNC", "len", "len"), ("FUNC", "cap", "cap"), ("FUNC", "panic", "panic"),
    ("FUNC", "recover", "recover"),
]

# --- FIXED VALUES: declaration kind labels used by completion output -------
KIND_LABELS = ["TYPE", "FUNC", "VAR", "PACKAGE", "CONST"]
UNKNOWN_KIND_LABEL = "???"

# --- FIXED VALUES: highlight classes ---------------------------------------
CLS_OPERATOR = "Operator"
CLS_SEPARATOR = "Separator"
CLS_KEYWORD = "Keyword"
CLS_COMMENT = "Comment"
CLS_TOKEN = "Token"
CLS_ERROR = "Error"
CLS_STRING = "String"
CLS_CHAR = "Char"
CLS_NUMBER = "Number"
CLS_VAR = "Var"
CLS_VAR_DEF = "VarDef"
CLS_CON = "Con"
CLS_CON_DEF = "ConDef"
CLS_TYPE = "Type"
CLS_TYPE_DEF = "TypeDef"
CLS_METH = "Meth"
CLS_METH_DEF = "MethDef"

# --- FIXED VALUES: literal class -> type of the literal --------------------
LITERAL_TYPES = {"STRING": "string", "CHAR": "int", "INT": "int",
                 "FLOAT": "float64", "IMAG": "complex128"}

# --- FIXED VALUES: diagnostics levels and messages --------------------------
LVL_INFO, LVL_WARN, LVL_ERROR = "INFO", "WARN", "ERROR"
MSG_TYPE_UNDEFINED = "type `%s' undefined"
MSG_VALUE_UNDEFINED = "`%s' undefined"
MSG_TYPE_IDENT_REQUIRED = "type ident required"
MSG_STRUCT_REQUIRED = "struct type required instead of '%s'"
MSG_POINTER_REQUIRED = "pointer type required"
MSG_TYPE_ARG_REQUIRED = "type argument required"
MSG_INVALID_PATH = "invalid path syntax"
MSG_IDENT_REQUIRED = "ident node required"
MSG_UNBALANCED = "invalid expression node"
MSG_BRACKET_EXPECTED = "expected '%s', found '%s'"
MSG_BRACKET_OPEN = "missing '%s'"
MSG_BRACKET_STRAY = "unexpected '%s'"
ERROR_WIDTH_PREFIX = "expected '.', found 'IDENT' "

# --- FIXED VALUES: command protocol ----------------------------------------
MSG_MIN_ARGS = 'min %d args required in cmd "%s"'
MSG_UNKNOWN_COMMAND = "<UnknownCommand: %s>"
MSG_DIRS_FOUND = "%d dirs found"
MSG_SRC_NOT_FOUND = "Src [%s] not found in %s\n"
MSG_PKG_NOT_FOUND = "Package [%s] not found\n"
SET_FILE_MODE, DROP_FILE_MODE = "SET-FILE-MODE", "DROP-FILE-MODE"
SOURCE_SUFFIX = ".go"
USAGE_KINDS = ["def", "decl", "ref"]
USAGE_NOREC = "norecursive"

# FIXED VALUES: minimum argument counts of the editor commands.
COMMAND_MIN_ARGS = [
    ("go-path", 1), ("go-root", 1), ("load-project", 0), ("reload", 1),
    ("changed", 4), ("analyze", 1), ("complete", 2), ("tooltip-info", 1), ("find-files", 3),
    ("file-in-project", 1), ("quit", 0),
]

# --- FIXED VALUES: name and path tables --------------------------------------
NAME_BUCKETS = 65536
PATH_BUCKETS = 1024

# --- token patterns (shared by Java regex and RE2; whitespace spelled out) ---
# Generic text: identifiers, numbers, double-quoted strings, whitespace runs,
# any other single character.  Tiles every text.
TEXT_TOKEN_RX = (r'[\p{L}_][\p{L}\p{N}_]*|[0-9]+(?:\.[0-9]+)?|"[^"\n]*"'
                 r'|[ \t\r\n\f]+|[^\p{L}_0-9 \t\r\n\f]')

# HTML: comments, open tags, close tags, words, other runs, a lone '<'.
HTML_TOKEN_RX = (r'<!--(?:[^-]|-[^-])*-->|</?[A-Za-z][^<>]*>'
                 r'|[\p{L}_][\p{L}\p{N}_]*|[^<\p{L}_]+|<')

# Go source: comments, raw and interpreted strings, runes, numbers,
# identifiers, whitespace, multi-character operators, single characters.
GO_TOKEN_RX = (r'//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|`[^`]*`|"(?:\\.|[^"\\\n])*"'
               r"|'(?:\\.|[^'\\\n])*'"
               r'|0[xX][0-9A-Fa-f_]*(?:\.[0-9A-Fa-f_]*)?(?:[pP][+-]?[0-9_]+)?i?|0[bBoO][0-9_]+i?'
               r'|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?i?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?i?'
               r'|[\p{L}_][\p{L}\p{N}_]*|[ \t\r\n\f]+'
               r'|<<=|>>=|&\^=|\.\.\.|:=|<-|\+\+|--|==|!=|<=|>=|&&|\|\||<<|>>|&\^'
               r'|[-+*/%&|^]=|(?s:.)')

# HTML container tags that open a scope (they balance in the corpus).
CONTAINER_TAGS = ["head", "nav", "ul", "li", "a", "div", "article", "h1", "footer"]

# Number of most frequent lower-case words used as the builtin tier of pages.
PAGE_BUILTIN_TOP = 30
