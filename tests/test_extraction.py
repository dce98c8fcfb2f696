"""Symbols, imports, skeletons, chunks and log lines on literal inputs."""

import ast
import json
import random
import re

from pyspark.sql import functions as F

from contextmill.api import ContextEngine
from contextmill.operators import chunking, upkeep, usage
from contextmill.operators.symbols import complexity, extract_imports, extract_symbols
from contextmill.plans.catalogue import index
from contextmill.sources.files import source_files
from contextmill.sources.store import Store

FILES = {
    "/p/a.py": 'import os, sys as y\nfrom .m import z\n\n@dec\n@dec2(1)\ndef f(a,\n      b):\n    """Doc."""\n    if a:\n        return 1\n\n# c\nclass C:\n    x = 1\n    def g(self, q: int):\n        pass\n\n    def h(self): return 2\nx = 3\nasync def k():\n    """Multi\n    line\n    """\n    return 1\n',
    "/p/b.go": 'package b\n\nimport (\n\t"fmt"\n\tx "os"\n)\nimport "io"\n\ntype S struct {\n\tA int\n\tB string // b\n}\n\ntype I interface {\n\tM() int\n}\n\ntype T int\n\nfunc F(a int,\n\tb int,\n) error {\n\treturn nil\n}\n\nfunc (s *S) M() int { return 1 }\n',
    "/p/c.ts": 'import { a } from "./a";\nimport {\n  b,\n} from \'./b\';\nexport class K {\n  x: number = 1;\n  foo(): void;\n  bar() {\n    return 1;\n  }\n}\nexport interface P {\n  q: string;\n}\nexport type U = string | number;\nexport enum E {\n  A,\n}\nexport const z = (v) => {\n  return v;\n};\nlet w = 5;\nexport default function main(a: number) {\n  return a;\n}\n',
    "/p/d.sh": "source ./lib.sh\n. other.sh\nfoo() {\n  echo 1\n}\nfunction bar {\n  echo 2\n}\n",
    "/p/e.fish": "source lib.fish\nfunction a\n  if test 1\n    echo\n  end\nend\n",
    "/p/f.yaml": "---\n# c\nkey1: 1\nkey2:\n  a: 1\n  b: 2\n\nkey3: x\n",
    "/p/g.yml": "- name: play one\n  hosts: all\n  tasks:\n    - name: t1\n      debug: msg=x\n    - include_tasks: foo.yml\n  handlers:\n    - name: h1\n      service: x\n- hosts: b\n  roles:\n    - role: web\n",
    "/p/h.tf": 'resource "aws_x" "y" {\n  a = 1\n  b {\n    c = 2\n  }\n}\nmodule "m" {\n  source = "./mod"\n}\nz = 4\n',
    "/p/i.log": "l1\nl2", "/p/l.yml": "- a\n- name: bb\n  v: 1\n", "/p/none.md": "# x\n",
}


def files(spark):
    return spark.createDataFrame([(f, "/p", c) for f, c in FILES.items()], "file string, project_path string, content string")


def test_symbols(spark):
    rows = extract_symbols(files(spark), include_logs=True).collect()
    got = {(r["file"][3:], r["kind"], r["name"], r["start_line"], r["end_line"]) for r in rows}
    assert got == {
        ("a.py", "function", "f", 4, 10), ("a.py", "class", "C", 13, 18), ("a.py", "function", "k", 20, 24),
        ("b.go", "struct", "S", 9, 12), ("b.go", "interface", "I", 14, 16), ("b.go", "type", "T", 18, 18),
        ("b.go", "function", "F", 20, 24), ("b.go", "method", "M", 26, 26),
        ("c.ts", "class", "K", 5, 11), ("c.ts", "interface", "P", 12, 14), ("c.ts", "type", "U", 15, 15), ("c.ts", "enum", "E", 16, 18),
        ("c.ts", "variable", "z", 19, 21), ("c.ts", "variable", "w", 22, 22), ("c.ts", "function", "main", 23, 25),
        ("d.sh", "function", "foo", 3, 5), ("d.sh", "function", "bar", 6, 8), ("e.fish", "function", "a", 2, 6),
        ("f.yaml", "key", "key1", 3, 3), ("f.yaml", "key", "key2", 4, 6), ("f.yaml", "key", "key3", 8, 8),
        ("g.yml", "play", "play one", 1, 9), ("g.yml", "task", "t1", 4, 5), ("g.yml", "task", "tasks[1]", 6, 6),
        ("g.yml", "handler", "h1", 8, 9), ("g.yml", "play", "play[1]", 10, 12),
        ("h.tf", "resource", "aws_x.y", 1, 6), ("h.tf", "module", "m", 7, 9), ("h.tf", "variable", "z", 10, 10),
        ("i.log", "plaintext", "i.log", 1, 2), ("l.yml", "item", "item[0]", 1, 1), ("l.yml", "item", "bb", 2, 3)}
    skeleton = {r["name"]: r["skeleton"] for r in rows}
    assert skeleton["C"] == "class C:\n    x = 1\n    def g(self, q:\n    def h(self):"
    assert skeleton["k"] == 'async def k():\n    """Multi\n    line\n    """'
    assert skeleton["S"] == "type S struct {\n\tA int\n\tB string // b\n}"
    assert skeleton["K"] == "export class K {\n  x: number = 1;\n  foo(): void;\n}"
    assert skeleton["key2"] == "key2:\n  a:\n  b:" and skeleton["aws_x.y"] == 'resource "aws_x" "y" {\n  a\n}'
    assert skeleton["M"] == "func (s *S) M() int" and skeleton["t1"] == "    - name: t1\n      debug: msg=x"
    fqn = {r["name"]: (r["fqn"], r["code"]) for r in rows}
    assert fqn["f"] == ("a.py.f", "@dec") and fqn["i.log"] == ("/p/i.log#plaintext", "l1\nl2")


def test_imports(spark):
    got = {(r["source_file"][3:], r["target"]) for r in extract_imports(files(spark)).collect()}
    assert got == {("a.py", "os"), ("a.py", "sys as y"), ("a.py", ".m"), ("b.go", "fmt"), ("b.go", "os"), ("b.go", "io"), ("c.ts", "./a"),
                   ("c.ts", "./b"), ("d.sh", "./lib.sh"), ("d.sh", "other.sh"), ("e.fish", "lib.fish"), ("g.yml", "foo.yml"), ("g.yml", "web"), ("h.tf", "./mod")}


def test_embed_hash(spark):
    import hashlib
    df = spark.createDataFrame([("/p/f.go", "/p", "func f() {}")], "file string, project_path string, content string")
    assert extract_symbols(df).first()["embed_hash"] == hashlib.sha256(b"function f: func f() {}").hexdigest()[:32]
    big = "func g() {\n\t" + "é" * 400 + "\n}"
    df = spark.createDataFrame([("/p/f.go", "/p", big)], "file string, project_path string, content string")
    assert extract_symbols(df).first()["embed_hash"] == hashlib.sha256(b"function g: " + big.encode()[:500]).hexdigest()[:32]


def test_complexity(spark):
    assert spark.range(1).select(complexity(F.lit("if a && b:\n for x in y: pass\nelse: ifx"))).first()[0] == 4


def sections(spark, column, text):
    df = spark.createDataFrame([(text, "path")], "t string, p string")
    return [tuple(s) for s in df.select(column.alias("s")).first()["s"]]


def test_markdown(spark):
    got = sections(spark, chunking.markdown_sections("t", "p"), "pre\n# Top\nintro\n\n## Section A\nalpha\n\n### Detail\nbeta\n\n## Section B\ngamma")
    assert got == [("path", "pre"), ("Top", "intro"), ("Section A", "alpha\n\n### Detail\nbeta"), ("Section B", "gamma")]
    assert sections(spark, chunking.markdown_sections("t", "p"), "no heading\n#no") == [("path", "no heading\n#no")]


def test_html(spark):
    html = "<title>Docs</title><h1>Intro</h1><p>Hi<script>x</script></p><h2>Tools</h2>tools/list and <b>tools/call</b><h3>bad</h4>x<h2></h2>y"
    assert sections(spark, chunking.page_sections("t", "p"), html) == [("Intro (h1)", "Hi"), ("Tools (h2)", "tools/list and tools/call")]
    assert sections(spark, chunking.page_sections("t", "p"), "<p>plain</p>") == [("path", "plain")]
    assert sections(spark, chunking.page_sections("t", "p"), "<title>T</title>x")[0][0] == "T"


def test_json(spark):
    df = spark.createDataFrame([('{"b":{"oauth":true,"a":[1]},"a":"x"}', "p"), ('[{"a":1},2]', "q"), ("nope {", "r"), ("7", "s")], "j string, p string")
    got = [(r["p"], r["title"], r["content"]) for r in chunking.json_sections(df, "j", "p").orderBy("p", "position").collect()]
    assert got == [("p", "a", '"x"'), ("p", "b", '{\n  "a": [\n    1\n  ],\n  "oauth": true\n}'), ("q", "q", '{"a":1}\n2'), ("r", "r", "nope {"), ("s", "s", "7")]


def pack_paragraphs(title, text, size):
    """The same packing as a loop over bytes."""
    import re
    content = text.strip()
    if not content:
        return []
    if len(content.encode()) <= size:
        return [(title, content)]
    out, buf = [], ""

    def flush():
        nonlocal buf
        if buf:
            n = len(out) + 1
            out.append((title + (f" (part {n})" if n > 1 else ""), buf.strip()))
            buf = ""

    for p in [q.strip() for q in re.split(r"\n\s*\n", content) if q.strip()]:
        raw = p.encode()
        if len(raw) > size:
            flush()
            for i in range(0, len(raw), size):
                n = len(out) + 1
                out.append((title + (f" (part {n})" if n > 1 or i + size < len(raw) else ""), raw[i:i + size].decode()))
            continue
        if len(buf.encode()) + len(raw) + 2 > size:
            flush()
        buf = p if not buf else buf + "\n\n" + p
    flush()
    return out


def test_long_sections_equal_the_loop(spark):
    rnd, texts = random.Random(3), []
    for _ in range(60):
        paragraphs = ["x" * rnd.choice([1, 5, 20, 39, 40, 41, 90, 130]) for _ in range(rnd.randint(0, 12))]
        texts.append(rnd.choice(["\n\n", "\n \n", "\n\n\n"]).join(paragraphs))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: [tuple(c) for c in r["c"]] for r in df.select("i", chunking.split_long(F.lit("T"), F.col("t"), 40).alias("c")).collect()}
    assert got == {i: pack_paragraphs("T", t, 40) for i, t in enumerate(texts)}


def test_hard_cuts_keep_characters_whole(spark):
    texts = ["é" * 50, "x" + "é" * 50, "€" * 40, "xx" + "𝄞" * 30, "a" * 81]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("i", chunking.split_long(F.lit("T"), F.col("t"), 40).alias("c")).collect():
        pieces = [c["content"] for c in r["c"]]
        assert "".join(pieces) == texts[r["i"]]
        assert max(len(p.encode()) for p in pieces) <= 43 and len(pieces) == -(-len(texts[r["i"]].encode()) // 40)


def test_log_lines(spark):
    lines = ["2024/01/02 03:04:05 request failed", "plain warning", "ok", "2024/01/02 03:04:05 fine"]
    got = [tuple(r["f"]) for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").orderBy("i").select(usage.log_fields(F.col("l")).alias("f")).collect()]
    assert got == [("error", "2024/01/02 03:04:05", "request failed"), ("warn", "", "plain warning"), ("info", "", "ok"), ("info", "2024/01/02 03:04:05", "fine")]


def test_retention(spark):
    import datetime as dt
    day = lambda n: dt.datetime(2024, 5, 1) - dt.timedelta(days=n)
    log = spark.createDataFrame([(day(120),), (day(90),), (day(0),)], "timestamp timestamp_ntz")
    now = F.lit("2024-05-01 12:00:00").cast("timestamp_ntz")
    assert log.where(upkeep.expired(log, now)).count() == 1
    files = spark.createDataFrame([("a", 50, day(9)), ("b", 30, day(3)), ("c", 30, day(2)), ("d", 30, day(1))], "path string, size long, mtime timestamp_ntz")
    kept = lambda **k: sorted(r["path"] for r in upkeep.retention(files, now, **k).where("NOT drop").collect())
    assert kept(max_age_days=5) == ["b", "c", "d"] and kept(max_age_days=5, max_total=60) == ["c", "d"]
    assert kept(max_total=140) == ["a", "b", "c", "d"] and kept(max_total=139) == ["b", "c", "d"] and kept() == ["a", "b", "c", "d"]


def test_generated_files_hold_whole_texts(spark):
    text = 'say "no"\nand "yes"\nback \\ slash "\n- hosts: b\n'
    docs = spark.createDataFrame([(1, text, "en", "web")], "doc_id long, text string, lang string, source string")
    rows = index.python_symbols(docs).orderBy("start_line").collect()
    assert [(r["name"], r["start_line"], r["end_line"]) for r in rows] == [("fn_1", 4, 6), ("fn_2", 8, 11), ("fn_3", 13, 15), ("fn_4", 17, 20), ("fn_5", 22, 24)]
    content = index._python_files(docs, index._escaped).first()["content"].replace("from .en import x", "")
    assert [ast.get_docstring(f, clean=False) for f in ast.parse(content).body if isinstance(f, ast.FunctionDef)] == text.split("\n")
    # the lines reach the YAML parser, quoted, and leave names and places alone
    files = index._yaml_files(docs)
    content = files.first()["content"]
    assert [json.loads(m) for m in re.findall(r'msg: (".*?")\}?$', content, re.M)] == text.split("\n")
    got = {(r["kind"], r["name"], r["start_line"]) for r in extract_symbols(files).collect()}
    assert got == {("play", "doc 1", 1), ("task", "tasks[0]", 4), ("task", "line 2", 6), ("task", "tasks[2]", 8), ("task", "line 4", 10), ("task", "tasks[4]", 12)}


def test_long_logs_are_kept_whole(spark, tmp_path):
    text = "".join(f"line {i} {'x' * 90}\n" for i in range(25_000)) + "the end"
    root = tmp_path / "logs"
    root.mkdir()
    (root / "a.log").write_text(text)
    found = source_files(spark, str(root), "/p", include_logs=True)
    rows = extract_symbols(found, include_logs=True).orderBy("start_line").select("start_line", "end_line", "code").collect()
    assert len(rows) == 2 and "\n".join(r["code"] for r in rows) == text
    assert max(len(r["code"]) for r in rows) <= 2 << 20 and rows[0]["start_line"] == 1
    assert rows[1]["start_line"] == rows[0]["end_line"] + 1 and rows[1]["end_line"] == 25_001
    cut = source_files(spark, str(root), "/p", include_logs=True, max_log_bytes=1000).first()["content"]
    assert cut == text[:1000]
    # and the engine's index holds every piece
    engine = ContextEngine(spark, Store(spark, str(tmp_path / "store")))
    engine.index_files(str(root), str(root), include_logs=True)
    assert engine.store.symbols().where("kind = 'plaintext'").agg(F.sum(F.length("code"))).first()[0] == len(text) - 1


def test_strings_comments_and_here_documents_are_no_code(spark):
    sources = {
        "/p/a.go": 'package a\n\nvar q = `\nfunc hidden() {\n`\n\nfunc F(s string) { // {\n\tx := "}" + "\\"{" + string(\'{\')\n\t/* }\n\t} */\n\tuse(x)\n}\n\n'
                   'type S struct {\n\tA func(int,\n\t\tint) // "\n\t// B: {\n\tC struct {\n\t\tD int\n\t}\n\tE string `json:"{"`\n}\n',
        "/p/b.ts": 'const a = `\nclass Hidden {\n${1}`;\nexport class K {\n  s = "}";\n  // t = 1;\n  r = m(/[{"]/);\n  f(\n    a: number,\n  ): void;\n  g() { return "}"; }\n}\n'
                   'interface P {\n  q: { r: string };\n  s: {\n    t: 1;\n  };\n  u: string;\n}\n',
        "/p/c.sh": 'foo() {\n  cat <<EOF\n}\nbar() {\nEOF\n  echo "}\n}" # }\n  echo ${#x}\n}\nbaz() { :; }\n',
        "/p/d.tf": 'resource "r" "n" {\n  t = <<EOT\n}\nmodule "x" {\nEOT\n  l = [\n    1,\n  ]\n  v = "${f("a")} {" # }\n  w = 2\n}\n',
        "/p/e.py": 'X = """\ndef hidden():\n    pass\n"""\ndef f():\n    # """\n    return \'"""\'\ndef g():\n    """\nnot code\n    """\n    return 1\n'}
    df = spark.createDataFrame([(f, "/p", c) for f, c in sources.items()], "file string, project_path string, content string")
    rows = {(r["file"][3:], r["name"]): r for r in extract_symbols(df).collect()}
    assert {k: (r["start_line"], r["end_line"]) for k, r in rows.items()} == {
        ("a.go", "F"): (7, 12), ("a.go", "S"): (14, 22), ("b.ts", "a"): (1, 3), ("b.ts", "K"): (4, 12), ("b.ts", "P"): (13, 19),
        ("c.sh", "foo"): (1, 9), ("c.sh", "baz"): (10, 10), ("d.tf", "r.n"): (1, 11), ("e.py", "f"): (5, 7), ("e.py", "g"): (8, 12)}
    assert rows["a.go", "F"]["skeleton"] == "func F(s string)"
    assert rows["a.go", "S"]["skeleton"] == 'type S struct {\n\tE string `json:"{"`\n}'
    assert rows["b.ts", "K"]["skeleton"] == 'export class K {\n  s = "}";\n  r = m(/[{"]/);\n}'
    assert rows["b.ts", "P"]["skeleton"] == "interface P {\n  q: { r: string };\n  u: string;\n}"
    assert rows["d.tf", "r.n"]["skeleton"] == 'resource "r" "n" {\n  t\n  v\n  w\n}'


def test_long_literals(spark):
    body = "\n".join(f'\tx("{i} \\" }}")' for i in range(40_000))
    df = spark.createDataFrame([("/p/a.go", "/p", "func F() {\n" + body + "\n}\nfunc G() {}\n")], "file string, project_path string, content string")
    assert sorted((r["name"], r["start_line"], r["end_line"]) for r in extract_symbols(df).collect()) == [("F", 1, 40_002), ("G", 40_003, 40_003)]
