import hashlib
from collections import defaultdict
from fractions import Fraction

from contextmill.llm import mixing

from .helpers import AWKWARD, clashing, documents, prose


def share(budget, kids):
    """kids: name -> (weight, limit); raises the common level until the budget is used."""
    given, left, open_kids = {}, budget, dict(kids)
    while open_kids:
        total = sum(w for w, _ in open_kids.values())
        full = {k for k, (w, lim) in open_kids.items() if Fraction(lim, w) <= Fraction(left, total)}
        if not full:
            given.update({k: w * left // total for k, (w, _) in open_kids.items()})
            break
        first = min(full, key=lambda k: (Fraction(open_kids[k][1], open_kids[k][0]), k))
        given[first] = open_kids[first][1]
        left -= open_kids.pop(first)[1]
    return given


def brute(rows):
    source_of = {s: d for d, names in mixing.DOMAINS.items() for s in names}
    leaves, docs = defaultdict(int), []
    for doc, text, lang, source, _ in rows:
        n = -(-len((text or "").encode()) // 4)
        if n:
            key = (source_of.get(source, "other"), lang or "", source or "")
            leaves[key] += n
            docs.append((doc, key, n))
    weights = (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {})
    budgets = {(): sum(leaves.values()) * mixing.SHARE[0] // mixing.SHARE[1]}
    for depth in range(3):
        nodes = defaultdict(dict)
        for key, n in leaves.items():
            w, lim = nodes[key[:depth]].get(key[depth], (weights[depth].get(key[depth], 1), 0))
            nodes[key[:depth]][key[depth]] = (w, lim + n * mixing.MAX_EPOCHS)
        budgets = {(*p, k): g for p, kids in nodes.items() for k, g in share(budgets[p], kids).items()}
    out = []
    for key, n in leaves.items():
        whole, rest = divmod(budgets[key], n)
        mine = [(int(hashlib.md5(f"{mixing.SEED}:{whole}:{'' if d is None else d}".encode()).hexdigest()[:15], 16), d, t) for d, k, t in docs if k == key]
        for h, d, t in mine:
            cum = sum(x[2] for x in mine if x[0] <= h)
            out += [(d, e) for e in range(whole + (cum <= rest))]
    return sorted(out, key=repr)


def drawn(df):
    return sorted(((r.doc_id, r.epoch) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    texts = [prose(i, 5 + i % 90) for i in range(300)] + AWKWARD
    rows = [(i if i % 50 else None, t, [None, "en", "de", "fr", "xx"][i % 5], ["src0", "src7", "src11", "src15", "src99", None, "src1"][i % 7], 0) for i, t in enumerate(texts)]
    rows += rows[3:6]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for bucket in (7, 20_000):
        assert drawn(mixing.mix(clashing(df), rows_per_bucket=bucket)) == brute(rows)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "src0", 1, 100), ("a", "en", "src1", 1, 10), ("b", "en", "src6", 100, 1000)],
                                   "domain string, lang string, source string, n long, tokens long")
    got = {r.source: r.given for r in mixing.leaf_budgets(leaves, 180, 1, {}, {}, {}).collect()}
    assert got == {"src0": 80, "src1": 10, "src6": 90}


def test_extra_columns_stay_and_empty_tables(spark):
    df = documents(spark, ["some text here"] * 4).withColumn("epoch", mixing.F.lit("old")).withColumn("url", mixing.F.lit("u"))
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "url", "domain", "n_tokens", "epoch"]
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(documents(spark, [None, ""])).count() == 0
