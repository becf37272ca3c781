"""Substring dedup against a plain version of its rule: lines and sentences, offsets and edge cases."""

from __future__ import annotations

import random
import re

import pytest

from stationlake.llm import substring_dedup as sd
from tests.llm.conftest import make_docs

BLANKS = " \t\x0b\f\r"
LONG = "Here is one long sentence with quite many different words in it, more than eighty signs of them all."
OTHER = "It goes on with another long sentence of many words that nobody would ever write twice by any chance."


def key(unit):
    unit = re.sub(f"[{BLANKS}]+", " ", unit.strip(BLANKS))
    unit = "".join(c.lower() if "A" <= c <= "Z" else c for c in unit)
    return unit if len(unit) >= sd.MIN_CHARS else None


def sentences(line):
    """Cut behind every mark that blanks follow, one sign after the other."""
    found, at, n = [], 0, 0
    while n < len(line):
        if line[n] in ".!?…。！？":
            end = n + 1
            while end < len(line) and line[end] in "\"')]»”’」』）":
                end += 1
            behind = end
            while behind < len(line) and line[behind] in BLANKS:
                behind += 1
            if line[n] in "。！？" or behind > end:
                found.append(line[at:behind])
                at = n = behind
                continue
        n += 1
    return found + ([line[at:]] if at < len(line) else [])


def brute(docs):
    """Kept texts of (id, text) rows, which have no two texts under one id."""
    seen, result = set(), {}
    for doc_id, text in sorted((d for d in dict.fromkeys(docs) if d[0] is not None), key=lambda d: d[0]):
        lines = []
        for line in (text or "").split("\n"):
            whole, parts = key(line), sentences(line)
            later = whole is not None and whole in seen
            if whole is not None:
                seen.add(whole)
            left = []
            for part in parts:
                own = key(part) if len(parts) > 1 else None
                if not later and own not in seen:
                    left.append(part)
                if own is not None:
                    seen.add(own)
            if left or not parts:
                lines.append("".join(left))
        result[doc_id] = "\n".join(lines)
    return result


def kept_texts(spark, texts):
    rows = {r.doc_id: r for r in sd.dedup_units(make_docs(spark, texts).repartition(3)).collect()}
    for doc_id, text in enumerate(texts):
        removed = [text[s.first : s.after] for s in rows[doc_id].spans]
        assert len(text) == len(rows[doc_id].kept) + sum(map(len, removed)) and all(removed)
        assert all(a.after < b.first for a, b in zip(rows[doc_id].spans, rows[doc_id].spans[1:], strict=False))
    return [rows[n].kept for n in range(len(texts))]


def test_random_texts_equal_the_plain_rule(corpus, monkeypatch):
    monkeypatch.setattr(sd, "COMMON", 3)
    rng = random.Random(8)
    units = [f"{LONG} {n}" if n % 2 else f"sentence {n} " + "ab " * 30 + rng.choice("x.!") for n in range(12)]
    units += ["Yes.", "1.", "short one. ", "  ", "", "今天的天气非常好所以我们去公园散步" * 6 + "。", "。", "(a)! ", "mixed\tCASE words " * 6 + "?) "]
    texts = []
    for _ in range(150):
        lines = [rng.choice(["", " ", "  "]).join(rng.choice(units) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(5))]
        texts.append("\n".join(lines))
    right = brute(list(enumerate(texts)))
    assert kept_texts(corpus, texts) == [right[n] for n in range(len(texts))]
    assert any(right[n] != text for n, text in enumerate(texts))


def test_only_later_occurrences_go(corpus):
    """Everything that goes stands in an earlier document, and what is unique or short stays."""
    texts = [
        f"{LONG} {OTHER}", f"{LONG} Dose 5 mg. {OTHER}", f"5 mg before it\n{LONG}\nonly here\nYes.\n1.\nLe treque.",
        "Yes.\n1.\nLe treque.\n5 mg", f"{OTHER}\n\n{OTHER} And more.",
    ]
    kept = kept_texts(corpus, texts)
    assert kept == [texts[0], "Dose 5 mg. ", "5 mg before it\nonly here\nYes.\n1.\nLe treque.", texts[3], "\nAnd more."]


@pytest.mark.parametrize("line", [
    "ALL RIGHTS RESERVED " * 5, "Der Hund Lief Zum Haus " * 5, "今天天气很好" * 15, "สวัสดีครับ" * 10, "привет мир " * 9, LONG[:80],
])
def test_lines_of_any_script_and_case(corpus, line):
    assert len(line.strip()) >= 80
    texts = [f"first of its kind\n{line}\nend one", f"second of its kind\n  {line} \nend two", f"{line.strip()[:79]}"]
    assert kept_texts(corpus, texts) == [texts[0], "second of its kind\nend two", texts[2]]


def test_passages_within_lines_of_any_script_and_case(corpus):
    for passage in ("these words come again and again in lower case, " * 2 + "so they do.", LONG.upper(), "今天的天气非常好" * 12 + "。"):
        gap = "" if passage[0] == "今" else " "
        texts = [f"some text。{gap}{passage}{gap}more of it", f"unlike it。{gap}{passage}{gap}something else", f"a unique {passage[:7]} line"]
        assert kept_texts(corpus, texts) == [texts[0], f"unlike it。{gap}something else", texts[2]]


def test_rows_that_share_an_id(corpus):
    rows = [(1, LONG), (2, LONG), (2, OTHER), (2, OTHER), (3, OTHER), (None, OTHER), (4, None), (5, "")]
    docs = make_docs(corpus, rows).selectExpr("*", "'x' as kept", "1 as place", "2 as twin", "3 as digest", "4 as spans")
    found = sorted((str(r.doc_id), r.kept) for r in sd.dedup_units(docs).collect())
    assert found == sorted([("1", LONG), ("2", ""), ("2", OTHER), ("2", OTHER), ("3", ""), ("None", OTHER), ("4", ""), ("5", "")])
    assert sd.dedup_units(make_docs(corpus, [])).count() == 0


def test_very_long_texts(corpus):
    rng = random.Random(1)
    many = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(n) for _ in range(14)) + "." for n in range(2000)]
    texts = ["\n".join(many), " ".join(many), "y" * 200_000, "y" * 200_000, ". " * 50_000]
    assert kept_texts(corpus, texts) == [texts[0], "", texts[2], "", texts[4]]
