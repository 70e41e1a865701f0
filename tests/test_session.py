"""End-to-end command processing over a scanned corpus (our own snippets)."""

import os

import pytest

from tessera.sources.catalog import scan_corpus
from tessera.streaming.session import process_commands

A = "package p\n\nvar counter int\n\nfunc run() {\n\tcount := 1\n\tvar u Unknown\n\t_ = cou\n}\n"
B = "package p\n\nfunc other() {}\n"


def test_process_commands(spark, scratch):
    src = os.path.join(scratch, "src", "p")
    os.makedirs(src)
    with open(os.path.join(src, "a.go"), "w") as f:
        f.write(A)
    with open(os.path.join(src, "b.go"), "w") as f:
        f.write(B)
    corpus = scan_corpus(spark, scratch)
    pos = A.index("_ = cou") + len("_ = cou")
    lines = [
        "go-root /r",
        f'go-path "{scratch}"',
        "load-project",
        "# a comment",
        "analyze -n 9 $GOPATH/src/p/a.go",
        f"complete $GOPATH/src/p/a.go {pos}",
        'find-files "" system 1',
        "file-in-project x.go",
        "tooltip-info a.go 3",
        "bogus 1",
        "analyze",
        "analyze $GOPATH/src/zz/a.go",
        "quit",
        "load-project",
    ]
    cmds = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    out = process_commands(cmds, corpus).orderBy("seq", "line_no").collect()
    by = {}
    for r in out:
        by.setdefault(r.seq, []).append(r.line)
    apath = os.path.join(scratch, "src", "p", "a.go")
    assert 0 not in by and 1 not in by                       # settings print nothing
    assert by[2] == ['MESSAGE "3 dirs found"', "MESSAGE-END", ""]
    u = A.encode().index(b"Unknown")
    assert by[4] == ["ERRORS-CLEAR ", "ERRORS-CLEAR-END", "", f'ERRORS "{apath}" 9',
                     f'  ERROR {u} {u + 7} "type `Unknown\' undefined"', "ERRORS-END", ""]
    c = A.encode().index(b"cou\n")
    assert by[5][0] == f'COMPLETE "cou" {c} {c + 3} "cou"'
    assert by[5][1] == f'  VAR "count" "count" {c} {c + 5}'        # local first
    assert by[5][2] == f'  VAR "counter" "counter" {c} {c + 7}'
    assert by[5][-2:] == ["COMPLETE-END", ""]
    assert by[6][0] == 'FILES "system"' and len(by[6]) == 4        # capped at max = 1
    assert by[7] == ['SET-FILE-MODE "x.go"', "SET-FILE-MODE-END", ""]
    assert 8 not in by                                              # tooltip-info: no output
    assert by[9] == ['MESSAGE "<UnknownCommand: bogus 1>"', "MESSAGE-END", ""]
    assert by[10] == ['MESSAGE "min 1 args required in cmd \\"analyze \\""', "MESSAGE-END", ""]
    zz = os.path.join(scratch, "src", "zz")
    assert by[11] == [f'MESSAGE "Package [{zz}] not found\\n"', "MESSAGE-END", ""]
    assert 13 not in by                                             # after quit


def test_command_stream_carries_settings(spark, scratch):
    import json
    from tessera.streaming.session import command_stream
    src = os.path.join(scratch, "src", "p")
    os.makedirs(src)
    with open(os.path.join(src, "a.go"), "w") as f:
        f.write(A)
    corpus = scan_corpus(spark, scratch)
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox)
    with open(os.path.join(inbox, "1.json"), "w") as f:
        f.write(json.dumps({"seq": 1, "line": f'go-path "{scratch}"'}) + "\n")
    apath = os.path.join(scratch, "src", "p", "a.go")
    u = A.encode().index(b"Unknown")
    with open(os.path.join(inbox, "1b.json"), "w") as f:
        f.write(json.dumps({"seq": 1, "line": f'changed {apath} "Bogus" {u} {u + 7}'}) + "\n")
    with open(os.path.join(inbox, "2.json"), "w") as f:
        f.write(json.dumps({"seq": 2, "line": "analyze $GOPATH/src/p/a.go"}) + "\n")
    stream = spark.readStream.schema("seq long, line string").option("maxFilesPerTrigger", 1).json(inbox)
    out, state = os.path.join(scratch, "out"), os.path.join(scratch, "state")
    log_in, log_out = os.path.join(scratch, "log_in"), os.path.join(scratch, "log_out")
    command_stream(stream, corpus, out, state, os.path.join(scratch, "ck"),
                   {"availableNow": True}, log_in, log_out).awaitTermination()
    assert spark.read.text(log_in).count() == 3                  # every input line, once
    assert "ERRORS-CLEAR-END" in {r.value for r in spark.read.text(log_out).collect()}
    lines = [r.line for r in spark.read.parquet(out).orderBy("seq", "line_no").collect()]
    assert lines[:4] == ["ERRORS-CLEAR ", "ERRORS-CLEAR-END", "", f'ERRORS "{apath}" 0']
    # the edit of an earlier micro-batch is still applied
    assert lines[4] == f'  ERROR {u} {u + 5} "type `Bogus\' undefined"'


def test_six_micro_batches_after_one_setting(spark, scratch):
    """Settings and edits survive any number of batches; a batch run again replaces its own
    result; invalid settings and what follows a quit do not enter the state."""
    from tessera.streaming.session import command_stream_batch
    src = os.path.join(scratch, "src", "p")
    os.makedirs(src)
    with open(os.path.join(src, "a.go"), "w") as f:
        f.write(A)
    corpus = scan_corpus(spark, scratch)
    path = os.path.join(src, "a.go")
    u = A.encode().index(b"Unknown")
    out, state = os.path.join(scratch, "out"), os.path.join(scratch, "state")
    batches = [[f'go-path "{scratch}"', f'changed {path} "Bogus" {u} {u + 7}'], ["load-project"], ["go-path"],
               ["load-project"], ["load-project"], ["analyze $GOPATH/src/p/a.go"],
               ["quit", f"reload {path}"], ["analyze $GOPATH/src/p/a.go"]]
    seq = 0
    for i, lines in enumerate(batches):
        df = spark.createDataFrame([(seq + k, x) for k, x in enumerate(lines)], "seq long, line string")
        seq += len(lines)
        for _ in range(2 if i in (0, 3) else 1):
            command_stream_batch(df, i, corpus, out, state)

    def lines_of(i):
        return [r.line for r in spark.read.parquet(f"{out}/batch={i}").orderBy("seq", "line_no").collect()]
    assert lines_of(4) == ['MESSAGE "3 dirs found"', "MESSAGE-END", ""]
    assert lines_of(2)[0].startswith('MESSAGE "min 1 args')
    assert lines_of(5)[4] == f'  ERROR {u} {u + 5} "type `Bogus\' undefined"'
    assert lines_of(7) == []
    assert spark.read.parquet(f"{state}/batch=6").count() == 3  # path, edit, quit
    with pytest.raises(Exception):
        command_stream_batch(df, 1, corpus, out, os.path.join(scratch, "nothing"))


def test_codeblocks_fontify(spark, scratch):
    src = os.path.join(scratch, "src", "p")
    os.makedirs(src)
    text = "package p\n\nvar v int\n"
    with open(os.path.join(src, "a.go"), "w") as f:
        f.write(text)
    corpus = scan_corpus(spark, scratch)
    path = os.path.join(src, "a.go")
    cmds = spark.createDataFrame([(0, f"analyze -n 2 {path}")], "seq long, line string")
    lines = [r.line for r in process_commands(cmds, corpus, codeblocks=True)
             .orderBy("seq", "line_no").collect()]
    assert lines[:6] == ["ERRORS-CLEAR ", "ERRORS-CLEAR-END", "", f'ERRORS "{path}" 2', "ERRORS-END", ""]
    assert lines[6] == f'FONTIFY "{path}" "{path}" 2 0 {len(text)}'
    assert lines[7:11] == ["  Keyword 0 7", "  TypeDef 8 9", "  Keyword 11 14", "  VarDef 15 16"]
    assert lines[11] == "  Type 17 20" and lines[-2:] == ["FONTIFY-END", ""]


def test_changed_and_reload_versions(spark, scratch):
    src = os.path.join(scratch, "src", "p")
    os.makedirs(src)
    with open(os.path.join(src, "a.go"), "w") as f:
        f.write(A)
    corpus = scan_corpus(spark, scratch)
    path = os.path.join(src, "a.go")
    u = A.encode().index(b"Unknown")
    cmds = [f"analyze {path}",
            f'changed {path} "Bogus" {u} {u + 7}',
            f"analyze {path}",
            f"reload {path}",
            f"analyze {path}",
            f'changed {path}x "a" 0 0']
    df = spark.createDataFrame(list(enumerate(cmds)), "seq long, line string")
    by = {}
    for r in process_commands(df, corpus).orderBy("seq", "line_no").collect():
        by.setdefault(r.seq, []).append(r.line)
    assert by[0][4] == f'  ERROR {u} {u + 7} "type `Unknown\' undefined"'
    assert by[2][4] == f'  ERROR {u} {u + 5} "type `Bogus\' undefined"'     # edited text
    assert by[4][4] == f'  ERROR {u} {u + 7} "type `Unknown\' undefined"'   # reload drops edits
    assert 1 not in by and 3 not in by
    assert by[5][0] == f'MESSAGE "Src [a.gox] not found in {src}\\n"'


def test_cli_runs_a_script(spark, scratch, capsys):
    from tessera import cli
    src = os.path.join(scratch, "src", "p")
    os.makedirs(src)
    with open(os.path.join(src, "a.go"), "w") as f:
        f.write(A)
    script = os.path.join(scratch, "script.cmds")
    with open(script, "w") as f:
        f.write(f'go-path "{scratch}"\n# comment\n\nload-project\nfile-in-project "unclosed.go\n')
    assert cli.main(["--roots", scratch, "--commands", script], spark=spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out == ['MESSAGE "3 dirs found"', "MESSAGE-END", "",
                   'SET-FILE-MODE "unclosed.go"', "SET-FILE-MODE-END", ""]
