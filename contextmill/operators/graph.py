"""Dependency edges: impact, unused symbols, project map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import basename, dirname, relative_path

GRAM = 3


def unused_symbols(symbols: DataFrame, edges: DataFrame, kind: str = "function") -> DataFrame:
    """Symbols that start no edge: functions and methods without a call, other kinds without an import."""
    callable_ = kind in ("", "function")
    wanted = F.col("kind").isin("function", "method") if callable_ else F.col("kind") == kind
    used = edges.where(F.col("kind") == ("call" if callable_ else "import")).select(
        F.col("source_file").alias("file"), F.col("source_symbol").alias("name")).distinct()
    return symbols.where(wanted).join(used, ["file", "name"], "left_anti").select("name", "file", "kind")


def _grams(text: Column, size: int) -> Column:
    n = F.length(text) - size + 1
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(n >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) for every distinct text that contains a pattern.

    Instead of comparing every pair, each pattern is looked up by its rarest three-character piece
    (the whole pattern when shorter), and only texts with that piece are checked.
    """
    pieces = texts.select("text", F.explode(F.concat(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)])).alias("gram"))
    own = F.when(F.length("pattern") >= GRAM, _grams(F.col("pattern"), GRAM)).otherwise(F.array("pattern"))
    wanted = patterns.select("pattern").distinct().where("pattern <> ''").select("pattern", F.explode(own).alias("gram"))
    # only pieces that some pattern has are counted: as many as the requests hold, not as the texts hold
    counts = pieces.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a piece no text has means the pattern matches nothing
    rarest = (wanted.join(counts, "gram", "left").groupBy("pattern")
              .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    return pieces.join(rarest, "gram").where(F.contains("text", F.col("pattern"))).select("text", "pattern")


def impact(edges: DataFrame, symbols: DataFrame, requests: DataFrame, exact: bool = False) -> DataFrame:
    """(query_id, source_file, target, kind): files whose import target contains the symbol, or the
    base name of a file that defines it; one row per file. With exact, the last path segment of the
    target must equal the name. requests: query_id, symbol."""
    asked = requests.select("query_id", F.lower("symbol").alias("symbol")).where("symbol <> ''")
    files = (symbols.select(F.lower("name").alias("symbol"), "file").distinct()
             .join(asked, "symbol").select("query_id", F.lower(basename("file")).alias("pattern")))
    patterns = asked.select("query_id", F.col("symbol").alias("pattern")).unionByName(files).distinct()
    targets = edges.select(F.lower("target").alias("text")).distinct()
    if exact:
        pairs = targets.withColumn("pattern", basename("text")).join(patterns.select("pattern").distinct(), "pattern")
    else:
        pairs = contains_join(targets, patterns)
    # the requests of one target, so that a target used by many files is expanded only once per request
    reached = pairs.join(patterns, "pattern").select("query_id", "text").distinct()
    rows = edges.withColumn("text", F.lower("target")).join(reached, "text")
    return rows.groupBy("query_id", "source_file").agg(
        F.min(F.struct("target", "kind")).alias("e")).select("query_id", "source_file", "e.target", "e.kind")


def impact_summary(impacted: DataFrame, symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, symbol, defined_in, total_files) counts per request."""
    totals = impacted.groupBy("query_id").agg(F.count_distinct("source_file").alias("total_files"))
    defined = (symbols.select(F.lower("name").alias("key"), "file").distinct()
               .join(requests.select("query_id", F.lower("symbol").alias("key")), "key")
               .groupBy("query_id").agg(F.count("*").alias("defined_in")))
    return requests.select("query_id", "symbol").join(defined, "query_id", "left").join(totals, "query_id", "left").na.fill(0)


def project_map(symbols: DataFrame, root: str, depth: int = 2) -> DataFrame:
    """Directories (depth 1), with their files and symbol counts (2), or every symbol in order (3).

    Rows, not nested lists: a directory may hold any number of files.
    """
    placed = symbols.withColumn("relative", relative_path("file", F.lit(root)))
    placed = placed.withColumn("directory", dirname("relative")).withColumn("file_name", basename("relative"))
    if depth <= 1:
        return placed.select("directory").distinct()
    if depth == 2:
        return placed.groupBy("directory", "file_name").agg(F.count("*").alias("symbols"))
    order = Window.partitionBy("directory", "file").orderBy("start_line", "name", "kind")
    return placed.withColumn("seq", F.row_number().over(order)).select("directory", "file_name", "seq", "name", "kind")
