import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kvlake.llm import scan
from kvlake.llm.quality import text_stats


def thue_morse(n):
    """A word of n letters and its complement: equal under every polynomial hash modulo 2**64."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abAB ", max_size=40), min_size=1, max_size=6))
def test_spans_hash_alike_only_if_equal(words):
    raw = "".join(words).encode()
    end = np.cumsum([len(w) for w in words]).astype(np.int64)
    start = end - [len(w) for w in words]
    for fold in (False, True):
        h = scan.span_hashes(np.frombuffer(raw, np.uint8), start, end, fold)
        same = [w.lower() if fold else w for w in words]
        assert all((h[i] == h[j]) == (same[i] == same[j]) for i in range(len(words)) for j in range(i))


def test_quality_counts_of_long_words():
    for n in (1024, 2048):
        x, y = thue_morse(n)
        s = text_stats(pa.array([f"{x}\n{y}", " ".join([x] * 5 + [y] * 5), f"{x} {y}"]))
        assert s["n_dup_lines"].tolist() == [0, 0, 0] and s["n_repeat_words"].tolist() == [0, 0, 0]
        assert s["n_types"].tolist() == [2, 2, 2]
