"""Line dedup: cuckoo filters, insertion and deletion, and cases that the SQL text does not reach."""

from __future__ import annotations

import numpy as np

from stationlake.llm import line_dedup as ld
from tests.llm.conftest import make_docs

LINE = "A line that is long enough to count as repeated."
OTHER = "Another line that is also long enough for counting."


def test_cuckoo_filter():
    keys = np.random.RandomState(1).randint(-(2**62), 2**62, 3000)
    found = ld.Cuckoo.for_keys(2000)
    assert found.insert(keys[:2000])
    assert found.known(keys[:2000]).all()
    assert found.known(keys[2000:]).mean() < 0.01
    empty = ld.Cuckoo.for_keys(2000).dump()
    found = ld.Cuckoo.load(found.dump())
    found.delete(keys[:2000])
    assert found.dump() == empty
    assert not ld.Cuckoo.for_keys(10).insert(keys)


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_insertion_and_deletion(corpus):
    first = make_docs(corpus, [LINE, f"{LINE}\nx", f" {LINE.upper()}\t", f"{OTHER}\n{LINE}"])
    more = make_docs(corpus, [f"{LINE}\n{OTHER}", OTHER, f"short\n{OTHER}", OTHER], first=10)
    both = first.unionByName(more)
    before = ld.LineIndex.build(first)
    assert before.drops(first).count() == 0
    after = before.insert(more).insert(more)
    whole = ld.LineIndex.build(both)
    assert rows(after.counts) == rows(whole.counts)
    assert rows(after.drops(both)) == rows(whole.drops(both))
    assert whole.drops(both).count() == 8
    back = after.delete(more.select("doc_id"))
    assert rows(back.counts) == rows(before.counts)
    assert rows(back.filters) == rows(before.filters)
    assert back.drops(both).count() == 0


def test_edges(corpus):
    texts = [(n, f"{LINE}\n{LINE}\nx{n}") for n in range(5)] + [(5, None), (6, ""), (None, LINE), (4, f"{LINE}\nx4")]
    docs = make_docs(corpus, texts).selectExpr("*", "'x' as digest", "2 as n_lines")
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in ld.dedup_lines(docs).collect())
    assert got == sorted(
        [(str(n), f"x{n}", 3, 2) for n in range(4)]
        + [("4", f"{LINE}\n{LINE}\nx4", 3, 0), ("4", f"{LINE}\nx4", 2, 0), ("5", "", 1, 0), ("6", "", 1, 0), ("None", LINE, 1, 0)]
    )
    assert ld.dedup_lines(make_docs(corpus, [])).count() == 0
