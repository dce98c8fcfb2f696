"""Symbols and import edges of source files.

Only top-level declarations count, and those begin at column 0 in the usual layout of every supported
language. They are recognised per line by declarative rules (language, pattern, kind) and closed by
their last bracket or the next top-level statement, both looked for in code alone: strings, comments and
here-documents are blanked first (functions/lexing.py). All of it is written with Spark's array functions: a file
is one row and stays one row until its symbols are exploded. Known gaps against a full parser: declarations
not at column 0, and only the first line of a grouped Go type declaration's keyword.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.languages import language_of
from ..functions.lexing import INSIDE, balance, code_only
from ..functions.scalars import basename, embed_hash, trim_space
from ..functions.text import lines as lines_of
from .rowwise import pinned
from .skeletons import outer_lines, skeleton

PLAINTEXT_BYTES = 2 << 20
_EXPORT = r"^(?:export\s+(?:default\s+)?)?"
_ID = r"([A-Za-z_$][\w$]*)"

# Declaration rules, first match wins; group 1 is the name.
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "python": ((r"^(?:async\s+)?def\s+([A-Za-z_]\w*)", "function"), (r"^class\s+([A-Za-z_]\w*)", "class")),
    "javascript": (
        (_EXPORT + r"(?:async\s+)?function\s+" + _ID, "function"), (_EXPORT + r"class\s+" + _ID, "class"),
        (r"^(?:export\s+)?(?:const|let|var)\s+" + _ID, "variable")),
    "typescript": (
        (_EXPORT + r"(?:async\s+)?function\s+" + _ID, "function"), (_EXPORT + r"class\s+" + _ID, "class"),
        (_EXPORT + r"interface\s+" + _ID, "interface"), (r"^(?:export\s+)?type\s+" + _ID + r"[^=]*=", "type"),
        (r"^(?:export\s+)?(?:const\s+)?enum\s+" + _ID, "enum"),
        (r"^(?:export\s+)?(?:const|let|var)\s+" + _ID, "variable")),
    "go": (
        (r"^func\s+([A-Za-z_]\w*)\s*[\(\[]", "function"), (r"^func\s*\([^)]*\)\s*([A-Za-z_]\w*)", "method"),
        (r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\b", "struct"),
        (r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\b", "interface"),
        (r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+[^=\s]", "type")),
    "bash": ((r"^(?:function\s+)?([\w:.-]+)\s*\(\)", "function"), (r"^function\s+([\w:.-]+)", "function")),
}
RULES["tsx"] = RULES["typescript"]

# Keys whose value names another file or role.
YAML_IMPORT_KEYS = "import_playbook|include_tasks|import_tasks|include_role|import_role|include"
TASK_SECTIONS = ("tasks", "handlers", "pre_tasks", "post_tasks")

_HIT = "array<struct<name:string,kind:string,first:int,last:int>>"


def _present(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _last_before(lines: Column, first: Column, stop: Column) -> Column:
    """Index of the last line in [first, stop) that is neither blank nor a comment at column 0."""
    body = F.slice(lines, first + 1, stop - first)
    solid = F.transform(body, lambda line, i: F.when((trim_space(line) != "") & ~F.startswith(line, F.lit("#")), i))
    return first + F.coalesce(F.array_max(solid), F.lit(0))


def _closing(code: Column, first: Column, stop: Column) -> Column:
    """Index of the line in [first, stop) where the brackets opened since first are closed again and no literal goes on."""
    def step(acc: Column, line: Column) -> Column:
        depth = acc["depth"] + balance(line)
        ended = (acc["depth"] <= 0) & (acc["n"] > 0) & ~F.startswith(line, F.lit(INSIDE))
        return F.when(acc["done"] | ended, F.struct(acc["depth"], F.lit(True).alias("done"), acc["n"])).otherwise(F.struct(
            depth.alias("depth"), F.lit(False).alias("done"), (acc["n"] + 1).alias("n")))

    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("done"), F.lit(0).alias("n"))
    return first + F.aggregate(F.slice(code, first + 1, stop - first), zero, step, lambda a: a["n"]) - 1


STATEMENT = r"^[^\s#)\]}/]"


def _indices(lines: Column, pattern: str) -> Column:
    return _present(F.transform(lines, lambda line, i: F.when(F.rlike(line, F.lit(pattern)), i)))


def _decorated_from(lines: Column, starts: Column) -> Column:
    """Per statement start the line where its run of decorators begins, null when it is no decorator."""
    def step(runs: Column, i: Column) -> Column:
        begin = F.coalesce(F.try_element_at(runs, F.lit(-1)), i)
        return F.array_append(runs, F.when(F.startswith(F.get(lines, i), F.lit("@")), begin))

    return F.aggregate(starts, F.array().cast("array<int>"), step)


def _declarations(lines: Column, code: Column, starts: Column, language: str) -> Column:
    """Top-level declarations of one rule-based language; starts are the lines that begin a statement."""
    def rule(line: Column) -> tuple[Column, Column]:
        kind = name = None
        for pattern, label in RULES[language]:
            hit = F.rlike(line, F.lit(pattern))
            kind = F.when(hit, label) if kind is None else kind.when(hit, label)
            part = F.regexp_extract(line, pattern, 1)
            name = F.when(hit, part) if name is None else name.when(hit, part)
        return kind, name

    def declared(i: Column, k: Column) -> Column:
        kind, name = rule(F.get(lines, i))
        stop = F.coalesce(F.get(starts, k + 1), F.size(lines))
        last = _last_before(lines, i, stop) if language == "python" else _closing(code, i, stop)
        first = i
        if language == "python":
            # decorators directly above belong to the declaration
            first = F.coalesce(F.get(F.col("marked"), k - 1), i)
        return F.when(kind.isNotNull(), F.struct(
            name.alias("name"), kind.alias("kind"), first.cast("int").alias("first"), last.cast("int").alias("last")))

    return _present(F.transform(starts, declared))


def _hcl(lines: Column, code: Column, starts: Column) -> Column:
    block = r'^([A-Za-z_][\w-]*)((?:\s+"[^"]*")*)\s*\{'
    attribute = r"^([A-Za-z_][\w-]*)\s*=(?!=)"

    def declared(i: Column, k: Column) -> Column:
        line = F.get(lines, i)
        is_block = F.rlike(line, F.lit(block))
        head = F.regexp_extract(line, block, 1)
        labels = F.array_join(F.regexp_extract_all(F.regexp_extract(line, block, 2), F.lit(r'"([^"]*)"'), F.lit(1)), ".")
        kind = F.when(is_block, head).when(F.rlike(line, F.lit(attribute)), "variable")
        name = F.when(is_block, F.when(labels != "", labels).otherwise(head)).otherwise(F.regexp_extract(line, attribute, 1))
        stop = F.coalesce(F.get(starts, k + 1), F.size(lines))
        return F.when(kind.isNotNull(), F.struct(
            name.alias("name"), kind.alias("kind"), i.cast("int").alias("first"), _closing(code, i, stop).cast("int").alias("last")))

    return _present(F.transform(starts, declared))


def _fish(lines: Column) -> Column:
    """function … end blocks, nesting counted over if, for, while, switch and begin."""
    def step(acc: Column, row: Column) -> Column:
        t = trim_space(row["line"])
        skip = (t == "") | F.startswith(t, F.lit("#"))
        name = F.regexp_extract(t, r"^function\s+(\S+)", 1)
        opens = F.startswith(t, F.lit("function ")) | F.rlike(t, F.lit(r"^(if |for |while |switch )")) | (t == "begin")
        closes = (t == "end") | F.startswith(t, F.lit("end;")) | F.startswith(t, F.lit("end #"))
        depth = acc["depth"] + opens.cast("int") - closes.cast("int")
        top = F.try_element_at(acc["stack"], F.lit(-1))
        ends = closes & top.isNotNull() & (top["depth"] == depth)
        pushed = F.array_append(acc["stack"], F.struct(
            name.alias("name"), row["i"].alias("first"), acc["depth"].alias("depth")))
        stack = (F.when(name != "", pushed)
                 .when(ends, F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1)).otherwise(acc["stack"]))
        found = F.array_append(acc["out"], F.struct(top["name"].alias("name"), F.lit("function").alias("kind"),
                                                    top["first"].alias("first"), row["i"].alias("last")))
        return F.when(skip, acc).otherwise(F.struct(
            depth.alias("depth"), stack.alias("stack"), F.when(ends, found).otherwise(acc["out"]).alias("out")))

    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<name:string,first:int,depth:int>>").alias("stack"),
                    F.array().cast(_HIT).alias("out"))
    rows = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def _unquote(text: Column) -> Column:
    return F.regexp_replace(trim_space(text), r"""^(["'])(.*)\1$""", "$2")


YAML_COMMENT = r"^\s*(#|---|%|$)"
YAML_KEY = r"""^(["']?)([^\s#:'"\-\[{][^:'"]*)\1\s*:(\s|$)"""
PLAY_KEY = r"^(?:- |  )([A-Za-z_][\w.]*)\s*:"


def _yaml_marks(lines: Column) -> dict[str, Column]:
    """Line numbers of top-level keys, list items, keys of list items and indented list items."""
    solid = F.filter(lines, lambda line: ~F.rlike(line, F.lit(YAML_COMMENT)))
    return {
        "y_list": F.rlike(F.coalesce(F.get(solid, F.lit(0)), F.lit("")), F.lit(r"^-(\s|$)")),
        "y_keys": _indices(lines, YAML_KEY), "y_items": _indices(lines, r"^-(\s|$)"),
        "y_sections": _indices(lines, PLAY_KEY), "y_tasks": _indices(lines, r"^ {2,4}-(\s|$)"),
        "y_playbook": F.exists(lines, lambda line: F.rlike(line, F.lit(r"^(?:- |  )(hosts|tasks|roles)\s*:")))}


def _yaml_tasks(lines: Column) -> Column:
    """(line, its section's line and name, next boundary) for the items of task sections."""
    sections, tasks, items = F.col("y_sections"), F.col("y_tasks"), F.col("y_items")

    def placed(i: Column, k: Column) -> Column:
        at = F.array_max(F.filter(sections, lambda s: s < i))
        name = F.regexp_extract(F.coalesce(F.get(lines, at), F.lit("")), PLAY_KEY, 1)
        later = [F.get(tasks, k + 1), F.array_min(F.filter(sections, lambda s: s > i)), F.array_min(F.filter(items, lambda s: s > i)), F.size(lines)]
        return F.struct(i.alias("i"), at.alias("at"), name.alias("section"), F.least(*later).alias("stop"))

    return F.filter(F.transform(tasks, placed), lambda t: t["section"].isin(*TASK_SECTIONS))


def _yaml(lines: Column) -> Column:
    """Top-level keys; or sequence items; or plays with their tasks and handlers. Needs the pinned
    columns of _yaml_marks and y_inside."""
    keys, items, inside, playbook = F.col("y_keys"), F.col("y_items"), F.col("y_inside"), F.col("y_playbook")
    count = F.size(lines)

    def hit(name: Column, kind: Column | str, first: Column, last: Column) -> Column:
        k = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(name.alias("name"), k.alias("kind"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    def solid_end(first: Column, stop: Column) -> Column:
        body = F.slice(lines, first + 1, stop - first)
        kept = F.transform(body, lambda line, j: F.when(~F.rlike(line, F.lit(YAML_COMMENT)), j))
        return first + F.coalesce(F.array_max(kept), F.lit(0))

    def named(first: Column, stop: Column, pad: Column) -> Column:
        """Value of 'name:' on the item line or among its sibling keys."""
        body = F.slice(lines, first + 1, stop - first)
        values = F.transform(body, lambda line, j: F.when(
            F.when(j == 0, F.rlike(line, F.lit(r"^\s*-\s+name\s*:\s*\S"))).otherwise(
                F.rlike(line, F.lit(r"^\s+name\s*:\s*\S")) & (F.length(F.regexp_extract(line, r"^\s*", 0)) == pad)),
            _unquote(F.regexp_replace(line, r"^[^:]*:", ""))))
        return F.get(_present(values), F.lit(0))

    mapping = F.transform(keys, lambda i, k: hit(
        F.regexp_extract(F.get(lines, i), YAML_KEY, 2), "key", i, solid_end(i, F.coalesce(F.get(keys, k + 1), count))))

    def item(i: Column, n: Column) -> Column:
        stop = F.coalesce(F.get(items, n + 1), count)
        label = F.when(playbook, F.lit("play[")).otherwise(F.lit("item["))
        name = F.coalesce(named(i, stop, F.lit(2)), F.concat(label, n.cast("string"), F.lit("]")))
        return hit(name, F.when(playbook, "play").otherwise("item"), i, solid_end(i, stop))

    def task(t: Column, k: Column) -> Column:
        i, stop = t["i"], t["stop"]
        pad = F.length(F.regexp_extract(F.get(lines, i), r"^\s*", 0)) + 2
        nth = k - F.size(F.filter(inside, lambda u: u["at"] < t["at"]))
        name = F.coalesce(named(i, stop, pad), F.concat(t["section"], F.lit("["), nth.cast("string"), F.lit("]")))
        return hit(name, F.when(t["section"] == "handlers", "handler").otherwise("task"), i, solid_end(i, stop))

    tasks = F.when(playbook, F.transform(inside, task)).otherwise(F.array().cast(_HIT))
    return F.when(F.col("y_list"), F.concat(F.transform(items, item), tasks)).otherwise(mapping)


def _plain_pieces(lines: Column, size: int) -> Column:
    """(first, last) of runs of whole lines, each of at most size bytes or one line; together they are all lines."""
    def step(acc: Column, line: Column) -> Column:
        bytes_, at = F.octet_length(line) + 1, acc["at"]
        full = (acc["used"] > 0) & (acc["used"] + bytes_ > size)
        return F.struct((at + 1).alias("at"), F.when(full, bytes_).otherwise(acc["used"] + bytes_).alias("used"),
                        F.when(full, F.array_append(acc["starts"], at)).otherwise(acc["starts"]).alias("starts"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("used"), F.array(F.lit(0)).alias("starts"))
    starts = F.aggregate(lines, zero, step, lambda a: a["starts"])
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(lines)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b - 1).alias("last")))


def extract_symbols(files: DataFrame, include_logs: bool = False, plaintext_bytes: int = PLAINTEXT_BYTES) -> DataFrame:
    """Rows of the symbol table from files (file, project_path, content), without ids.

    A log is one row, or several of at most plaintext_bytes each (or one longer line) where it is larger.
    """
    text = files.select("file", "project_path", "content", language_of("file", include_logs).alias("language"))
    text = pinned(text.where(F.col("language") != ""), lines=lines_of("content"),
                  code_lines=lines_of(code_only(F.col("content"), F.col("language")))).drop("content")
    lines, code, yaml = F.col("lines"), F.col("code_lines"), F.col("language") == "yaml"
    marks = {n: F.when(yaml, c) for n, c in _yaml_marks(lines).items()}
    text = pinned(text, starts=F.when(F.col("language").isin(*RULES, "hcl"), _indices(code, STATEMENT)), **marks)
    python = F.col("language") == "python"
    text = pinned(text, y_inside=F.when(yaml & F.col("y_playbook"), _yaml_tasks(lines)),
                  marked=F.when(python, _decorated_from(lines, F.col("starts"))))
    by_language = F.when(F.col("language") == "fish", _fish(lines))
    for language in RULES:
        by_language = by_language.when(F.col("language") == language, _declarations(lines, code, F.col("starts"), language))
    by_language = by_language.when(F.col("language") == "hcl", _hcl(lines, code, F.col("starts"))).when(yaml, _yaml(lines))
    if include_logs:
        whole = F.transform(_plain_pieces(lines, plaintext_bytes), lambda p: F.struct(
            basename("file").alias("name"), F.lit("plaintext").alias("kind"), p["first"].alias("first"), p["last"].alias("last")))
        by_language = by_language.when(F.col("language") == "plaintext", whole)
    # every symbol takes its own lines along, so that the exploded rows do not repeat the whole file
    taken = F.transform(F.col("hits"), lambda h: F.struct(
        h["name"].alias("name"), h["kind"].alias("kind"), (h["first"] + 1).alias("start_line"), (h["last"] + 1).alias("end_line"),
        F.slice(lines, h["first"] + 1, h["last"] - h["first"] + 1).alias("source_lines"),
        F.slice(code, h["first"] + 1, h["last"] - h["first"] + 1).alias("symbol_code")))
    text = pinned(text, hits=by_language).select("file", "project_path", "language", taken.alias("taken"))
    found = text.select("file", "project_path", "language", F.explode_outer("taken").alias("s")).where("s.name <> ''")
    rows = found.select("file", "project_path", "language", "s.*").select(
        "*", trim_space(F.get("source_lines", F.lit(0))).alias("first_line"), F.array_join("source_lines", "\n").alias("source"))
    bracketed = F.col("language").isin("go", "javascript", "typescript", "tsx", "hcl")
    rows = pinned(rows, outer=F.when(bracketed, outer_lines(F.col("symbol_code"))))
    plain = F.col("kind") == "plaintext"
    outline = skeleton(F.col("language"), F.col("kind"), F.col("source_lines"), F.col("symbol_code"), F.col("outer"))
    return rows.select(
        "name", "kind", "file", "start_line", "end_line",
        F.when(plain, F.col("source")).otherwise(F.col("first_line")).alias("code"),
        F.when(plain, F.concat("file", F.lit("#plaintext"))).otherwise(F.concat_ws(".", basename("file"), "name")).alias("fqn"),
        "project_path",
        F.when(plain, F.col("first_line")).otherwise(outline).alias("skeleton"),
        embed_hash("kind", "name", "source").alias("embed_hash"), "source")


def extract_imports(files: DataFrame) -> DataFrame:
    """(source_file, target, kind='import', project_path) from files (file, project_path, content)."""
    text = files.select("file", "project_path", "content", language_of("file").alias("language"))

    def found(pattern: str, group: int = 1, within: Column | None = None) -> Column:
        return F.regexp_extract_all(F.col("content") if within is None else within, F.lit(pattern), F.lit(group))

    def flat(items: Column, make) -> Column:
        return F.flatten(F.transform(items, make))

    python = F.concat(
        flat(found(r"(?m)^import[ \t]+([^\n#;]+)"), lambda s: F.transform(F.split(s, ","), trim_space)),
        found(r"(?m)^from[ \t]+(\S+)[ \t]+import\b"))
    script = F.concat(found(r"""(?m)^import\b[^'"\n]*['"]([^'"\n]+)['"]"""), found(r"""(?m)^\}[ \t]*from[ \t]*['"]([^'"\n]+)['"]"""))
    go = F.concat(found(r'(?m)^import[ \t]+(?:[\w.]+[ \t]+)?"([^"]+)"'),
                  flat(found(r"(?ms)^import\s*\((.*?)^\)"), lambda b: F.regexp_extract_all(b, F.lit(r'"([^"]+)"'), F.lit(1))))
    bash = found(r"""(?m)^(?:source|\.)[ \t]+["']?([^\s"']+)""")
    fish = found(r"(?m)^[ \t]*source[ \t]+(\S+)")
    hcl = flat(found(r'(?ms)^module\s+"[^"]*"\s*\{(.*?)^\}'),
               lambda b: F.regexp_extract_all(b, F.lit(r'(?m)^\s*source\s*=\s*"([^"]*)"'), F.lit(1)))
    keyed = rf"(?m)^[ \t]*(?:-[ \t]+)?(?:{YAML_IMPORT_KEYS})[ \t]*:[ \t]+([^\s#].*)$"
    roles = r"(?m)^[ \t]*(?:-[ \t]+)?role[ \t]*:[ \t]+([^\s#].*)$"
    yaml = F.transform(F.concat(found(keyed), found(roles)), _unquote)
    language = F.col("language")
    targets = (F.when(language == "python", python).when(language.isin("javascript", "typescript", "tsx"), script)
               .when(language == "go", go).when(language == "bash", bash).when(language == "fish", fish)
               .when(language == "hcl", hcl).when(language == "yaml", yaml))
    return (text.select(F.col("file").alias("source_file"), F.explode(targets).alias("target"),
                        F.lit("import").alias("kind"), "project_path").where("target <> ''"))


def complexity(source: Column) -> Column:
    """One plus the number of branching keywords and operators."""
    return 1 + F.regexp_count(source, F.lit(r"\b(?:if|elif|for|while|case|catch|except|when|switch)\b|&&|\|\||\?\s"))


def analyze_complexity(symbols: DataFrame, threshold: int = 10, limit: int = 20) -> DataFrame:
    """Most complex symbols at or above the threshold."""
    scored = symbols.select("name", "file", "kind", complexity(F.col("source")).alias("complexity"))
    return scored.where(F.col("complexity") >= threshold).orderBy(F.desc("complexity"), "file", "name").limit(limit)
