import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import induced_sort, repeated_spans


@settings(max_examples=150, deadline=None)
@given(values=st.lists(st.integers(0, 3), min_size=1, max_size=60), memory=st.sampled_from([2, 5, 1000]))
def test_suffixes_and_prefixes(tmp_path_factory, values, memory):
    folder = str(tmp_path_factory.mktemp("sort"))
    text = np.array(values, np.int64)
    order = sorted(range(len(values)), key=lambda i: values[i:])
    got = induced_sort.suffix_array(text, folder, memory)
    assert got.tolist() == order
    prefixes = induced_sort.common_prefixes(text, got, folder, memory).tolist()
    for rank in range(1, len(order)):
        a, b = values[order[rank - 1] :], values[order[rank] :]
        assert prefixes[rank] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("length", [20, 33])
def test_operator_agrees_with_induced_sorting(spark, tmp_path, length):
    from test_dedup import frame, span_texts

    rows = [(i, t or "") for i, t in enumerate(span_texts(random.Random(length)))]
    want = induced_sort.repeated_ranges([t.encode() for _, t in rows], length, str(tmp_path), memory=500)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeated_spans.removal_digests(frame(spark, rows), length).collect()}
    assert got == {i: (sum(b - a for a, b in w), len(w)) for (i, _), w in zip(rows, want)}
    assert induced_sort.repeated_ranges([], 5, str(tmp_path)) == []
