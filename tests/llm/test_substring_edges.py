"""Substring dedup: passages under one seed are told apart by the whole fingerprint."""

import numpy as np
import pyarrow as pa

from larder.llm import substring_dedup as S


def records(prints):
    n = len(prints)
    edges = S._edges(np.array(prints, np.uint64))
    return pa.RecordBatch.from_arrays(
        [pa.array([7] * n), pa.array(range(n)), pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([3] * n, pa.int32()),
         pa.array([e.tobytes() for e in edges], pa.binary())], ["seed", "id", "part", "start", "offset", "edges"])


def test_passages_alike_in_their_low_bits_are_no_repeat():
    base = 0x123456789A
    for shift in (40, 48, 56, 63):
        assert S.subtree_repeats(records([base, base + (1 << shift)])).num_rows == 0
        leaves = list(S._crowded_leaves([records([base, base + (1 << shift)])]))[0]
        assert len(set(leaves.column("edge").to_pylist())) == 2
    assert S.subtree_repeats(records([base, base, base + 1])).column("id").to_pylist() == [0, 1]
