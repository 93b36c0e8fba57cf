"""The randomness battery of op4: plain statistics, p-values and step-up rule, and its recall among names of real sources."""

import math
import pathlib
import random
import re

import numpy as np
import pyspark
import pytest
from pyspark.sql import functions as F

from taxolith.llm import secrets

ALPHABETS = {16: "0123456789ABCDEF", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def normal(z):
    z = max(-6.0, min(6.0, z))
    return 1 / (1 + math.exp(-(1.5976 * z + 0.07056 * z**3)))


def fisher(*p):
    total = -sum(math.log(max(x, 1e-12)) for x in p)
    return total - math.log(1 + total + total**2 / 2)


def battery(token):
    """(class, negative log p against a name, negative log p against uniform) in plain loops."""
    token = token.rstrip("=")
    cells = 16 if re.fullmatch("[0-9a-fA-F]+", token) else 32 if re.fullmatch("[A-Z2-7]+", token) else 64
    kind = ["U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s" for c in token]
    value = [{"U": 2.0, "l": 0.0}.get(k, 1.0) for k in kind]
    n, text = len(token), token.upper() if cells == 16 else token
    counts = [text.count(c) for c in ALPHABETS[cells]] + [text.count(c) for c in set(text) - set(ALPHABETS[cells])]
    chi = sum(c * c for c in counts) * cells / n - n
    changes = sum(a != b for a, b in zip(kind, kind[1:])) / (n - 1)
    off = [v - sum(value) / n for v in value]
    correlation = sum(a * b for a, b in zip(off, off[1:])) / sum(v * v for v in off)
    even = secrets.CHANGES[cells]
    uniform = fisher(normal((cells - 1 - chi) / math.sqrt(2 * (cells - 1) * (n - 1) / n)), 2 * normal(-abs(changes - even) * math.sqrt((n - 1) / (even * (1 - even)))), 2 * normal(-abs(correlation + 1 / n) * math.sqrt(n)))
    ic, ic_s, ch, ch_s, co, co_s = secrets.NAMES[cells]
    name = fisher(normal((chi - cells * ((n - 1) * ic + 1) + n) * math.sqrt(n) / (cells * (n - 1) * ic_s)), normal((ch - changes) * math.sqrt(n) / ch_s), normal((correlation - co) * math.sqrt(n) / co_s))
    return cells * 100 + int(math.log2(n)), name, uniform


def identifiers():
    """Runs of name characters in the sources of installed packages: words of program text, not secrets."""
    found = set()
    for package in (pyspark, np):
        for path in sorted(pathlib.Path(package.__file__).parent.rglob("*.py"))[:400]:
            found |= set(re.findall(secrets.CANDIDATE, path.read_text(errors="ignore")))
    return sorted(t for t in found if len(t) < 80)


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(17)
    planted = [(cells, n, "".join(rnd.choice(a) for _ in range(n))) for cells, a in ALPHABETS.items() for n in (20, 24, 32, 40, 64) for _ in range(20)]
    rows = [(0, 0, t) for t in identifiers()] + planted
    docs = spark.createDataFrame([(k, c, n, f"see {t} there") for k, (c, n, t) in enumerate(rows)], "doc_id long, cells int, n int, text string").repartition(4)
    return rows, docs


def test_p_values_are_the_plain_ones(made):
    rows, docs = made
    off = []
    for r in secrets.with_candidates(docs).where(F.size("tried") > 0).collect():
        for x in r.tried:
            token = r.text[x.start : x.end]
            key, name, uniform = battery(token)
            assert x["class"] == key
            want = math.floor(name * secrets.BIN) if uniform <= -math.log(secrets.UNLIKE) else 0
            off.append(abs(x.bin - want))
            assert abs(x.bin - want) <= (1 if abs(uniform + math.log(secrets.UNLIKE)) > 1e-6 else 999), token
    assert len(off) > 500 and np.mean([d == 0 for d in off]) > 0.99


def test_step_up_rule_is_the_plain_one(made):
    rows, docs = made
    candidates = secrets.with_candidates(docs)
    bins = {}
    for r in candidates.select("tried").collect():
        for x in r.tried:
            bins.setdefault(x["class"], []).append(x.bin)
    for key, own in bins.items():
        p = sorted(math.exp(-b / secrets.BIN) for b in own)
        passing = [k for k in range(len(p)) if p[k] * len(p) <= secrets.RATE * (k + 1)]
        least = secrets.accepted(candidates).get(key) if key in list(bins)[:3] else None
        if least is not None:
            assert passing and abs(math.exp(-least / secrets.BIN) - p[passing[-1]]) < 1e-12


def test_recall_among_names_of_real_sources(made):
    rows, docs = made
    found = {r.doc_id: any(s.kind == 3 for s in r.spans) or any(s.kind < 3 for s in r.spans) for r in secrets.scanned(docs).collect()}
    shares = {}
    for k, (cells, n, _) in enumerate(rows):
        shares.setdefault((cells, n), []).append(found[k])
    shares = {k: float(np.mean(v)) for k, v in shares.items()}
    print(shares, len(rows), [rows[k][2] for k in found if found[k] and not rows[k][0]])
    assert shares[0, 0] < 0.02
    for cells in ALPHABETS:
        for n in (24, 32, 40, 64):
            assert shares[cells, n] >= 0.9, (cells, n, shares[cells, n])


def test_alphabet_size_matters(spark):
    """Sixteen symbols of a 64-cell alphabet, in even shares: as near to names' repeats as hex is, but far from uniform."""
    rnd = random.Random(3)
    few = "".join(rnd.choice("gHjK4mN7pQrS9tVw") for _ in range(64))
    _, _, uniform = battery(few)
    assert uniform > -math.log(secrets.UNLIKE)
    docs = spark.createDataFrame([(1, f"x {few} y")], "doc_id long, text string")
    assert secrets.with_candidates(docs).first().tried[0].bin == 0
