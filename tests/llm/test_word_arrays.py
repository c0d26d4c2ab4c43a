import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelgraph.llm.word_arrays import shingle_sets, slices, split_words, text_buffers, window_hashes

TEXT = st.text(alphabet=st.sampled_from(list("ab \t\n\x0b\x0c\r\x1c\x85é日")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_bytes_split(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    for a, b in slices(offsets, 16):
        words = split_words(data, offsets[a : b + 1], lower=False)
        for i, text in enumerate(texts[a:b]):
            x, y = words.offsets[i : i + 2]
            got = [words.data[s:e].tobytes() for s, e in zip(words.starts[x:y], words.ends[x:y], strict=True)]
            assert got == (text or "").encode().split()


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_equal_windows_have_equal_hashes_and_others_differ(texts):
    data, offsets = text_buffers(pa.array(texts))
    words = split_words(data, offsets, lower=False)
    hashes, at = window_hashes(words, 3)
    seen = {}
    for i, text in enumerate(texts):
        w = text.encode().split()
        own = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert len(own) == at[i + 1] - at[i]
        for window, h in zip(own, hashes[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(window, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_of_short_texts():
    data, offsets = text_buffers(pa.array(["a b", "A b", "", "a b c d e f", "x", "a b c d e a b c d e a"]))
    sets, sizes = shingle_sets(split_words(data, offsets, lower=True), 5)
    assert sizes.tolist() == [1, 1, 0, 2, 1, 5]
    assert sets[0].tolist() == sets[1].tolist() != sets[4].tolist()
