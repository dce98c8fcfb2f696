import math
import random
import re
import string

import pytest

from contextmill.llm import secret_scan as S

from .helpers import AWKWARD, clashing, documents, prose

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASED = re.compile(r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}")


def parts(text):
    """(base spans, candidate runs), each with the string that may train the models."""
    text, base, runs, at = text or "", [], [], 0
    for m in [*ASSIGN.finditer(text), None]:
        gap = text[at:m.start() if m else len(text)]
        for r in re.finditer(r"[A-Za-z0-9+/_-]{16,}", gap):
            if re.search("[A-Za-z]", r[0]) and not BASED.search(r[0]):
                runs.append((at + r.start(), at + r.end(), r[0]))
        if m:
            at = m.end()
            if len(m[2]) >= 6:
                base.append((m.start(), 0, m.end(), m[2]))
    base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return base, runs


def brute(texts):
    found, samples = [parts(t) for t in texts], {True: set(), False: set()}
    for base, runs in found:
        samples[True] |= {s for _, k, _, s in base if k or re.fullmatch(r"[A-Za-z0-9+/_-]{16,}", s) and re.search("[A-Za-z]", s) and re.search("[0-9]", s)}
        samples[False] |= {s for _, _, s in runs if not re.search(r"[0-9+]", s)}
    counts = {kind: {} for kind in samples}
    for kind, strings in samples.items():
        for s in strings:
            for a, b in zip(s, s[1:]):
                counts[kind][a, b] = counts[kind].get((a, b), 0) + 1
                counts[kind][a] = counts[kind].get(a, 0) + 1
                counts[kind]["to", b] = counts[kind].get(("to", b), 0) + 1
    n = len(S.ALPHABET)

    def weight(a, b):
        random_, plain = ((counts[k].get((a, b), 0), counts[k].get(a, 0)) for k in (True, False))
        p = 0.5 / n + 0.5 * (random_[0] + 1 / n) / (random_[1] + 1)
        follows = [counts[False].get(("to", c), 0) + 0.1 for c in S.ALPHABET]
        q = (plain[0] + 6.6 * follows[S.ALPHABET.index(b)] / sum(follows)) / (plain[1] + 6.6)
        return math.floor(1000 * math.log(p / q) + 0.5)

    return [sorted([x[:3] for x in base] + [(b, 3, e) for b, e, s in runs if sum(map(weight, s, s[1:])) >= 3000 * (len(s) - 1)]) for base, runs in found]


def scanned(df):
    return [[(x["start"], x["kind"], x["end"]) for x in r["spans"]] for r in S.scan_secrets(df).orderBy("doc_id").collect()]


def secret(r, n, letters=string.ascii_letters + string.digits + "+/"):
    return "".join(r.choice(letters) for _ in range(n))


def mixed(seed, count=80, between=(" ", "\n", "/")):
    r = random.Random(seed)
    words = ["".join(r.choice(["re", "tion", "the", "an", "er", "load", "User", "_", "get"]) for _ in range(r.randrange(1, 9))) for _ in range(400)]
    texts = []
    for _ in range(count):
        w = [r.choice(words) for _ in range(60)]
        w[r.randrange(60)] = r.choice(["password", "API_KEY", "apikey", "Token", "secret"]) + r.choice(['="', "= '", ":", '" : "', " = "]) + secret(r, r.randrange(1, 40))
        w[r.randrange(60)] = r.choice(["AKIA" + secret(r, 16, string.ascii_uppercase + string.digits), secret(r, r.randrange(20, 50), "0123456789abcdef"), secret(r, 44), "4562298812442145"])
        texts.append(r.choice(["", "é", "😀 "]) + r.choice(between).join(w))
    return texts


def test_against_brute_force(spark):
    texts = mixed(1) + AWKWARD + ["token=token=abcdefgh", "secret=token: abcdefghij", "passwordpassword = 'x.y=zzz'token:aaaaaa", "ſecret=abcdefgh toKen=abcdefgh",
                                  "AKIAAKIA" + "A" * 20, "abcdef" * 5 + "token=" + "ab12" * 9 + "==", "token", "=", "a" * 15 + "token=xy" + "B7q" * 9]
    got = scanned(clashing(documents(spark, texts)))
    assert got == brute(texts)
    assert sum(k == 3 for spans in got for _, k, _ in spans) > 5


def test_models_add_random_strings_and_leave_identifiers(spark):
    r = random.Random(5)
    secrets = [secret(r, 40) for _ in range(60)]
    names = ["".join(r.choice(["re", "tion", "load", "User", "_", "get", "Table", "Row"]) for _ in range(8)) for _ in range(60)]
    texts = mixed(2, 600, (" ",)) + [f"x {s} y" for s in secrets] + [f"x {s} y" for s in names if len(s) >= 16]
    got = scanned(documents(spark, texts))[600:]
    assert sum(any(k == 3 for _, k, _ in spans) for spans in got[:60]) >= 57
    assert not any(got[60:])


@pytest.mark.parametrize("texts", [[], [None], ["", None, "no secret"], ["token = abcdefgh1"] * 3])
def test_small_tables(spark, texts):
    assert scanned(documents(spark, texts)) == brute(texts)


def test_long_text_and_many_matches(spark):
    r = random.Random(9)
    text = " ".join("token=" + secret(r, 12) for _ in range(3000)) + "a" * 5_000_000 + " " + secret(r, 20_000) + " " + prose(1, 200_000)
    assert scanned(documents(spark, [text])) == brute([text])


def test_no_python_in_the_plan(spark):
    plan = S.scan_secrets(documents(spark, ["token=abcdefgh"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
