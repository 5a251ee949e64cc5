"""Source chunks, context and budgets against a plain scan line by line; detection of languages by hand-made files."""

import random
import re

import pytest

from corpusloom.functions import languages
from corpusloom.operators import chunking, sourcecode

BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
MODIFIERS = "pub public private protected static async export abstract final open internal".split()
KEYWORDS = "class interface enum struct record trait module namespace function fn func def method sub proc procedure type impl entity architecture package component".split()
IMPORTS = "import include require use using from with".split()


def lines_of(text):
    return [x for x in re.split(r"(?<=\n)", text) if x]


def declared(line):
    """(keyword, name) of a line that declares something."""
    words = [w for w in re.split(f"[{BLANKS}]+", line.strip(BLANKS)) if w]
    while words and words[0].lower() in MODIFIERS and words[0].isascii():
        words.pop(0)
    if len(words) > 1 and words[0].isascii() and words[0].lower() in KEYWORDS:
        name = re.match(r"[A-Za-z_$][A-Za-z0-9_$.-]*", words[1])
        return (words[0].lower(), name[0]) if name else None
    return None


def imported(line):
    first = re.match(r"[A-Za-z0-9_]*", line.lstrip(BLANKS))[0]
    return first.isascii() and first.lower() in IMPORTS


def plain_blocks(text, logical=True):
    out, now, depth = [], "", 0
    for line in lines_of(text):
        if logical and now and depth == 0 and declared(line):
            out.append(now)
            now = ""
        if logical:
            depth = max(0, depth + sum(line.count(c) for c in "({[") - sum(line.count(c) for c in ")}]"))
        now += line
        if depth == 0 and not line.strip(BLANKS):
            out.append(now)
            now = ""
    return [*out, now] if now else out


def plain_spans(text, most, logical=True):
    parts = []
    for b in plain_blocks(text, logical):
        while len(b.encode()) > most:
            n = max((k for k in range(1, len(b)) if b[k - 1] == "\n" and len(b[:k].encode()) <= most), default=0)
            n = n or max(k for k in range(1, len(b)) if len(b[:k].encode()) <= most)
            parts.append(b[:n])
            b = b[n:]
        parts.append(b)
    out = []
    for p in parts:
        if out and len((out[-1] + p).encode()) <= most:
            out[-1] += p
        else:
            out.append(p)
    return out


def plain_overlap(text, target):
    if target <= 0:
        return ""
    lines = lines_of(text)
    return min(("".join(lines[i:]) for i in range(len(lines))), key=lambda s: (abs(len(s.encode()) - target), -len(s)))


def plain_chunks(path, text, language, logical, o):
    spans = plain_spans(text, o.most, logical)
    at, known, imports = 0, [], []
    for line in lines_of(text):
        if declared(line):
            known.append((at, at + len(line.encode()), declared(line)[1], line.strip(BLANKS)[:240]))
        if imported(line):
            quoted = re.search("[\"'<]([^\"'>]+)[\"'>]", line.strip(BLANKS))
            imports.append(quoted[1] if quoted else line.strip(BLANKS)[:120])
        at += len(line.encode())
    out, lo = [], 0
    for k, span in enumerate(spans):
        hi = lo + len(span.encode())
        head = []
        if o.context != "none":
            head = ["# " + "/".join(path.split("/")[-3:])] if path else []
            head.append(f"# Language: {language}")
            if logical:
                mine = [s for a, _, _, s in known if lo <= a < hi]
                head += ["# Defines: " + ", ".join(mine)] if mine else []
                uses = [i for i in imports if not o.used_imports or i in span] if o.context == "full" else []
                head += ["# Uses: " + ", ".join(uses)] if uses else []
                before, after = [n for _, b, n, _ in known if b <= lo], [n for a, _, n, _ in known if a >= hi]
                if o.siblings != "none":
                    head += [f"# After: {before[-1]}"] if before else []
                    head += [f"# Before: {after[0]}"] if after else []
            head.append("")
        over = plain_overlap(spans[k - 1], int(o.most * o.overlap + 0.5)) if k else ""
        out.append((span, "\n".join([*head, *(["# ...", over, "# ---"] if over else []), span])))
        lo = hi
    return out


PIECES = [
    "def alpha(a):\n", "    return {\n", "}\n", ")\n", "\n", "  \n", "\xa0\n", "class Beta { // [\n", "public static void type Gamma\n", "pub fn d1(\n", "import os\n",
    'from "x/y" import z\n', "using <vector>\n", "é漢😀 text\n", "word " * 9 + "\n", "no newline ", "DEF Up\n", "export  abstract\tclass\tTab$.x-y\n", "definition not\n",
    "use\n", "used\n", "]]]\n", "((\n", "\r\n", "function 9no\n", "ſtruct x\n", "enum E { A }\r\n", "x" * 300 + "\n", "\ufeffimpl Q\n",
]


def files_of(n, seed):
    rng = random.Random(seed)
    texts = ["", "\n", "\n\n", "a", "def a", "}\n}\n{\n\ndef b\n}\ndef c\n", "x" * 700, "é" * 400, "def a\n" * 60]
    return texts + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 70))) for _ in range(n)]


def test_blocks_equal_a_plain_scan(spark):
    texts = files_of(120, 1)
    got = {}
    for r in sourcecode.logical_blocks(spark.createDataFrame([*enumerate(texts), (900, None), (None, "a")], "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.block, r.byte_start, r.byte_end))
    for i, t in enumerate(texts):
        at, want = 0, []
        for b in plain_blocks(t):
            want.append((len(want), at, at + len(b.encode())))
            at += len(b.encode())
        assert sorted(got.get(i, [])) == want, t
    assert set(got) <= set(range(len(texts)))


OPTIONS = [
    sourcecode.Options(most=90), sourcecode.Options(most=300, context="minimal", siblings="names", overlap=0.5),
    sourcecode.Options(most=200, context="none", siblings="none", overlap=0.33), sourcecode.Options(most=150, used_imports=True, siblings="none", overlap=0),
]


@pytest.mark.parametrize("o", OPTIONS)
def test_chunks_equal_a_plain_scan(spark, o):
    texts = files_of(60, 2)
    rows = [(i, f"a/b/c/d{i}.x" if i % 3 else "", t, "lang", ("g" if i % 4 == 1 else None), "plain-text" if i % 4 == 0 else "extension") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (800, None, None, "l", None, "extension")], "doc_id long, path string, text string, language_id string, grammar string, detected_by string")
    got = {}
    for r in sourcecode.chunk_sources(df, o).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, path, t, language, grammar, by in rows:
        mine, logical = got.get(i, []), bool(grammar) or by != "plain-text"
        assert [(r.chunk, r.contextualized) for r in mine] == plain_chunks(path, t, language, logical, o)
        assert "".join(r.chunk for r in mine) == t
        at = 0
        for r in mine:
            n = len(r.chunk.encode())
            assert (r.byte_start, r.byte_end, r.total_chunks, r.token_count) == (at, at + n, len(mine), len(r.contextualized.encode()))
            assert r.line_start == t.encode()[:at].count(b"\n") + 1 and r.line_end == t.encode()[: at + n - 1].count(b"\n") + 1
            assert r.strategy == ("logical-boundary" if logical else "plain-text") and r.fallback_reason == (grammar and f"missing_tree_sitter_grammar:{grammar}")
            at += n


def test_budget_has_all_four_ends(spark):
    """Files that fit at once, cut smaller, with less context, and not at all: as the plain scan tells, each with its own size."""
    o, budget = sourcecode.Options(most=400, overlap=0.2), 520
    texts = files_of(80, 4) + ["import " + "i" * 100 + "\n" + "def a\n" * 30, ("import " + "m" * 90 + "\n") * 6 + "text\n\n" * 90, "def " + "q" * 600 + "\n", "short\n"]
    rows = [(i, "x/y.zz", t, "zz", None, "heuristic") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, language_id string, grammar string, detected_by string")
    got = {}
    for r in sourcecode.chunk_sources(df, o, budget).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r)
    ends = set()
    for i, path, t, language, _, _ in rows:
        size = lambda chunks: max((len(c.encode()) for _, c in chunks), default=0)
        used = o
        want, retries = plain_chunks(path, t, language, True, o), 0
        if size(want) > budget:
            used = sourcecode.replace(o, most=max(128, int(o.most * (budget / size(want)) * 0.85)))
            want, retries = plain_chunks(path, t, language, True, used), 1
        if size(want) > budget:
            used = sourcecode.replace(used, context="minimal", siblings="names", overlap=0.0)
            want, retries = plain_chunks(path, t, language, True, used), 2
        mine = got.get(i, [])
        if size(want) > budget:
            assert [(r.error, r.chunk, r.retries) for r in mine] == [("embedding_input_too_large", None, 2)]
            ends.add("error")
        else:
            assert [(r.chunk, r.contextualized, r.retries, r.most, r.error) for r in mine] == [(a, b, retries, used.most, None) for a, b in want]
            ends.add(retries if want else 0)
    assert ends == {0, 1, 2, "error"}


def test_entities(spark):
    text = "  Public class Box {\nfn go()\nenum\nTYPE T😀\nmethod " + "m" * 300 + "\nimpl X.y-z for\ninterface I"
    got = sourcecode.file_entities(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")).orderBy("number").collect()
    assert [(r.name, r.kind) for r in got] == [("Box", "class"), ("go", "function"), ("T", "type"), ("m" * 300, "method"), ("X.y-z", "class"), ("I", "interface")]
    assert got[0].signature == "Public class Box {" and len(got[3].signature) == 240 and got[2].signature == "TYPE T😀"
    assert [(r.byte_start, r.byte_end) for r in got[:2]] == [(0, 21), (21, 29)]


def test_overlap_of_rows_equals_a_plain_scan(spark):
    texts = files_of(60, 7)
    rows = [(i // 6, i, t if i % 11 else None, f"# h{i}" if i % 4 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file long, n long, text string, header string")
    got = {r.n: r for r in sourcecode.with_overlap(df, ["file"], "n", most=200, ratio=0.3).collect()}
    for k, (f, n, t, h) in enumerate(rows):
        over = plain_overlap(rows[k - 1][2] or "", 60) if k and rows[k - 1][0] == f and rows[k - 1][2] else ""
        assert (got[n].overlap or "") == over
        assert got[n].contextualized == "\n".join([*([h, ""] if h else []), *(["# ...", over, "# ---"] if over else []), t or ""])


CASES = [
    ("a/README.md", "def a\nimport b\n", "text", "plain-text"), ("readme.py", "x", "text", "plain-text"), ("License", "def a\nimport b\n", "source", "heuristic"),
    ("x/Makefile", "", "makefile", "filename"), ("Dockerfile.dev", "", "dockerfile", "filename"), ("q/a.CMake.in", "", "cmake", "extension"), ("b.h", "", "c", "extension"),
    ("c.m", "", "objective-c", "extension"), ("d.es", "", "erlang", "extension"), ("e.ts", "", "typescript", "extension"), ("f.rs.in", "", "rust", "extension"), ("g.app.src", "", "erlang", "extension"),
    ("run", "#!/usr/bin/env  python3 -u\n", "python", "shebang"), ("run", "#! bash", "bash", "shebang"), ("run", "#!/bin/bash\nimport x", "source", "heuristic"), ("run", "#!/bin/bash\n", "text", "plain-text"),
    ("example.futurelang", "from a\nfunction go(x) { y: 1 }\n", "futurelang", "heuristic"), ("x.C++", "", "text", "plain-text"), ("notes.q7", "just prose (really): yes\n", "text", "plain-text"),
    ("many.zig9", "\n" * 250 + "def late\nimport late\n", "text", "plain-text"), ("odd.", "class A\n use b;(x)", "source", "heuristic"), (None, None, "text", "plain-text"), ("s/p.CS", "", "csharp", "extension"),
    ("lib.v", "", "verilog", "extension"), (".bashrc", "", "bash", "filename"), ("conf.toml", None, "toml", "extension"),
]


def test_detection(spark):
    df = spark.createDataFrame([(i, p, t, "clash") for i, (p, t, _, _) in enumerate(CASES)], "doc_id long, path string, text string, grammar string")
    got = {r.doc_id: r for r in languages.detect_sources(df).collect()}
    for i, (path, text, language, by) in enumerate(CASES):
        assert (got[i].language_id, got[i].detected_by) == (language, by), (path, text, got[i])
    assert got[16].language_name == "Unknown source (futurelang)" and got[16].grammar is None
    assert got[12].grammar == "python" and got[0].language_name == "Plain text"
    assert languages.detect_sources(df.limit(0)).count() == 0


def test_detection_needs_no_shuffle_of_files(spark, capsys):
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _, _) in enumerate(CASES)], "doc_id long, path string, text string")
    languages.detect_sources(df).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_paragraphs_end_behind_other_blanks():
    import numpy as np

    raw = np.frombuffer("a\n \nb\n\x1c\nc".encode(), np.uint8)
    assert chunking.paragraph_ends(raw).tolist() == [5, raw.size]
