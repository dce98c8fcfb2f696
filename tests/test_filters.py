from pyspark.sql import functions as F

from contextmill.functions.globs import DEFAULT_IGNORES, any_glob, excluded_project, walkable
from contextmill.functions.languages import fence, language_label, language_of
from contextmill.functions.scalars import (ancestors, dirname, human_size, is_stale, normalize_outcome, normalize_reason,
                                           normalize_scope, relative_path, share_label)
from contextmill.functions.text import line_range, prefix_terms, query_terms
from contextmill.operators import filters


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_parse():
    parse = filters.SearchFilters.parse
    assert parse({}) is None
    assert parse({"kinds": "function, method"}).kinds == ("function", "method")
    assert parse({"kinds": "function, function", "kind": "function"}).kinds == ("function",)
    assert parse({"kinds": ["a", 1, " b "]}).kinds == ("a", "b")


def test_predicate(spark):
    f = filters.SearchFilters.parse({"path_prefix": "internal/mcp", "kinds": "function", "language": "Go"})
    rows = spark.createDataFrame([("/proj/internal/mcp/server.go", "function"), ("/proj/internal/mcp/server.go", "type"),
                                  ("/proj/internal/db/x.go", "function"), ("/proj/internal/mcpx/y.go", "function"),
                                  ("/proj/internal/mcp/readme.md", "function")], "file string, kind string")
    assert [tuple(r) for r in rows.where(f.predicate("/proj")).collect()] == [("/proj/internal/mcp/server.go", "function")]
    unknown = filters.SearchFilters.parse({"language": "cobol"})
    assert rows.where(unknown.predicate("/proj")).count() == 0
    absolute = filters.SearchFilters.parse({"path_prefix": "/proj/internal/mcp/"})
    assert rows.where(absolute.predicate("/other")).count() == 3


def test_query_terms(spark):
    terms, prefixes = one(spark, query_terms(F.lit("tools/list  MCP é")), prefix_terms(F.lit("tools/list  MCP é")))
    assert terms == ["tools/list", "mcp", "é"] and prefixes == ["toolslist", "mcp"]


def test_globs(spark):
    def hit(path, *patterns):
        return one(spark, any_glob(F.lit(path), patterns))[0]

    assert hit("frontend/node_modules/lodash/index.js", *DEFAULT_IGNORES)
    assert hit("a/build/x.go", "**/build/**") and hit("build", "**/build/**") and not hit("a/rebuild/x", "**/build/**")
    assert hit("a/b/gen.go", "**/gen.go") and hit("gen.go/x", "**/gen.go") and not hit("a/xgen.go", "**/gen.go")
    assert hit("docs/a/b", "docs/**") and hit("docs", "docs/**") and not hit("x/docs/a", "docs/**")
    assert hit("a/b", "a") and not hit("ab", "a")
    assert hit("x/y/z.log", "*.log") and hit("x/y/z.log", "y/*.log") and not hit("x/y/z.log", "x/*.log")
    assert hit("a1", "a[0-9]") and hit("ab", "a?") and not hit("a/b", "a?b")
    assert not hit("../x/node_modules/y", *DEFAULT_IGNORES)


def test_excluded_projects(spark):
    def out(path):
        return one(spark, excluded_project(F.lit(path), ["basename:outputs", "/tmp/excluded-repo", "/home/*/old"]))[0]

    assert out("/a/outputs") and out("/tmp/excluded-repo") and out("/tmp/excluded-repo/sub") and out("/home/j/old")
    assert not out("/tmp/excluded-repo2") and not out("/a/b")


def test_walkable(spark):
    assert one(spark, walkable(F.lit("a/b.py")), walkable(F.lit("a/.git/b.py")), walkable(F.lit("vendor/b.py")), walkable(F.lit("a/vendored/b.py"))) == (
        True, False, False, True)


def test_scopes_and_owners(spark):
    links = spark.createDataFrame([("/g", "/g/foo"), ("/g", "/g/foo/bar"), ("/h", "/h/x")], "parent_path string, child_path string")
    roots = spark.createDataFrame([("/g",), ("/z",)], "root string")
    assert sorted(tuple(r) for r in filters.scope_paths(links, roots).collect()) == [("/g", "/g"), ("/g", "/g/foo"), ("/g", "/g/foo/bar"), ("/z", "/z")]
    files = spark.createDataFrame([("/g/foo/a.go",), ("/g/foo/bar/b.go",), ("/g/c.go",), ("/g/foox/d.go",)], "file string")
    owners = {r["file"]: r["owner"] for r in filters.owning_project(files, links, "/g").collect()}
    assert owners == {"/g/foo/a.go": "/g/foo", "/g/foo/bar/b.go": "/g/foo/bar", "/g/c.go": "/g", "/g/foox/d.go": "/g"}
    paths = spark.createDataFrame([("/g",), ("/g/foo",), ("/gx",), (".",), (None,)], "project_path string")
    assert [tuple(r) for r in filters.auto_links(paths).collect()] == [("/g", "/g/foo")]
    rows = spark.createDataFrame([("/g", "/g/foo/a.go"), ("/g", "/g/c.go"), ("/g/foo", "/g/foo/a.go")], "project_path string, file string")
    assert sorted(tuple(r) for r in filters.purge_parent_duplicates(rows, links).collect()) == [("/g", "/g/c.go"), ("/g/foo", "/g/foo/a.go")]


def test_small_scalars(spark):
    assert one(spark, ancestors(F.lit("/a/b/c")), ancestors(F.lit("/a")), dirname(F.lit("a/b")), dirname(F.lit("a"))) == (["/a", "/a/b"], [], "a", ".")
    assert one(spark, relative_path(F.lit("/p/x"), F.lit("/p")), relative_path(F.lit("/px"), F.lit("/p"))) == ("x", "/px")
    assert one(spark, human_size(F.lit(10)), human_size(F.lit(2048)), human_size(F.lit(3 << 20))) == ("10 B", "2.0 KB", "3.0 MB")
    assert one(spark, share_label(F.lit(12.4)), share_label(F.lit(3.41))) == ("12%", "3.4%")
    assert one(spark, normalize_reason(F.lit(" Quality ")), normalize_reason(F.lit("x")), normalize_outcome(F.lit("FAILED"))) == ("quality", "", "failed")
    assert one(spark, normalize_scope(F.lit(""), F.lit("s"), F.lit("")), normalize_scope(F.lit("project"), F.lit("s"), F.lit("")),
               normalize_scope(F.lit("global"), F.lit(""), F.lit(""))) == ("session", None, "global")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    assert one(spark, *[is_stale(F.lit(v), now) for v in ("", "not-a-date", "2024-01-09T00:00:00Z", "2024-01-02T00:00:00Z")]) == (True, True, False, True)
    text = F.lit("a\nb\nc")
    assert one(spark, line_range(text, F.lit(2), F.lit(3)), line_range(text, F.lit(0), F.lit(1)), line_range(text, F.lit(2), F.lit(4))) == ("b\nc", "", "")
    assert one(spark, language_of(F.lit("/a/B.PY")), language_of(F.lit("x.log")), language_of(F.lit("x.log"), True), language_of(F.lit("Makefile")),
               language_label(F.lit("a.tsx")), fence(F.lit("a.tsx"))) == ("python", "", "plaintext", "", "TSX", "typescript")
