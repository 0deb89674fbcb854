"""Measurements of whole texts against a plain version, bits, and ablations."""

import random
import re
from collections import Counter

from tableops.llm import rules
from tableops.llm.base import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if runs[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
        len(lines),
        len(set(words)),
        sum(c.isupper() for c in text),
        sum(w.endswith("!") for w in words),
    )


def test_measures():
    rng = random.Random(1)
    texts = ["", " \n\t", "a", "é b  c", "x " * 40, "One two\n\none two\nOne two\r\n", "A! B!! c!d"]
    texts += ["".join(rng.choices("ab \n#É!\x0b", k=rng.randint(0, 200))) for _ in range(300)]
    texts += [" ".join(rng.choices(["aa", "bb"], k=60)) for _ in range(50)]
    for t in texts:
        assert rules.measure(t) == plain(t), repr(t)


def test_ledger_policies_and_odd_rows(spark, make_docs):
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(1, None), (2, ""), (2, ""), (3, long), (4, "same words again and over " * 50), (5, "# " * 200), (None, long)]
    docs = make_docs(rows).withColumnsRenamed({"lang": "n_words", "source": "failed_bits"})
    got = rules.ledger(docs, "doc_id")
    by_id = {r.doc_id: r for r in got.collect()}
    few = rules._BIT["few_words"]
    assert by_id[1].failed_bits == by_id[2].failed_bits == few
    assert by_id[3].failed_bits == by_id[None].failed_bits == 0
    assert by_id[4].failed_bits & rules._BIT["repeated_windows"]
    assert by_id[5].failed_bits & rules._BIT["symbols"]
    kept = got.where(~rules.rejected("v1")).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "None"]
    assert got.count() == len(rows)
    assert rules.ledger(make_docs([]), "doc_id").collect() == []


def test_ablations_count_as_the_rules_do(spark):
    entries = rules.ledger(table(spark, "/root/testdata/sf0.001", "documents"), "doc_id")
    bits = [r.failed_bits for r in entries.collect()]
    got = {r.rule: (r.n_failed, r.n_rejected_alone) for r in rules.ablations(entries, "v1").collect()}
    for name in rules.POLICIES["v1"]:
        bit = rules._BIT[name]
        want = sum(bool(b & bit) for b in bits), sum(b == bit for b in bits)
        assert got[name] == want, name
    assert rules.ablations(entries.where("false"), "base").collect() == []
