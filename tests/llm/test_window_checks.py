import numpy as np
import pyarrow as pa

from heliograph.llm import substring_dedup


def test_windows_are_equal_on_all_64_bits_of_their_check(monkeypatch):
    """Two different windows of one seed and offset, whose checks differ in their lower halves only."""
    rows = []
    for doc, low in ((1, 5), (2, 6), (3, 5)):
        check = np.array([7 << 32 | low], np.uint64)
        one = np.array([0]), np.array([0]), np.array([1])
        monkeypatch.setattr(substring_dedup, "anchors", lambda *_, check=check, one=one: (np.array([9], np.uint64), *one, check))
        block = substring_dedup._Block()
        block.add(doc, doc, np.zeros(13, np.uint64), 13, 5)
        rows.append(block.rows())
    for batches in (rows, [pa.Table.from_batches(rows).combine_chunks().to_batches()[0]]):
        got = pa.Table.from_batches(list(substring_dedup._extend()(iter(batches)))).to_pylist()
        assert [r["doc_id"] for r in got] == [3]
