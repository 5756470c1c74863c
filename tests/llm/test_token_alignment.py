from __future__ import annotations

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsgauge.llm import token_alignment as t

pytestmark = pytest.mark.skipif(not os.path.exists(t.FOLDER), reason="no vocabularies")
FIRST, SECOND = os.path.join(t.FOLDER, t.BYTE_BPE), os.path.join(t.FOLDER, t.PIECE_BPE)


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers by their own libraries: ids with their bytes, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    letters = t._byte_letters()

    def encode(text):
        if not text:
            return None
        a = first.encode(" " + text, add_special_tokens=False)
        own = [(at, bytes(letters[c] for c in token)) for at, token in zip(a.ids, a.tokens, strict=True)]
        other = []
        for at in second.encode(text):
            piece = second.id_to_piece(at)
            other.append((at, bytes([int(piece[3:5], 16)]) if second.is_byte(at) else piece.replace("▁", " ").encode()))
        data = (" " + text).encode()
        if b"".join(x for _, x in own) != data or b"".join(x for _, x in other) != data:
            return None
        return own, other

    return encode


def _groups(own, other):
    def ends(tokens):
        return np.cumsum([len(data) for _, data in tokens]).tolist()

    found, at, other_at = [], 0, 0
    own_ends, other_ends = ends(own), ends(other)
    for cut in sorted(set(own_ends) & set(other_ends)):
        begin, other_begin = at, other_at
        while at < len(own) and own_ends[at] <= cut:
            at += 1
        while other_at < len(other) and other_ends[other_at] <= cut:
            other_at += 1
        found.append(([x for x, _ in own[begin:at]], [x for x, _ in other[other_begin:other_at]]))
    return found


def _shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(docs, encode):
    aligned, counts = [], Counter()
    for doc, text in docs:
        found = encode(text)
        groups = _groups(*found) if found else None
        aligned.append((doc, found, groups))
        if groups:
            counts.update({(a, b) for own, other in groups for a in own for b in other})
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    rows = []
    for doc, found, groups in aligned:
        if not found:
            rows.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a, b) for own, other in groups for a in own for b in other]
        best = sum(counts[link] == most[link[0]] for link in links)
        digest = hashlib.sha256(_shown(groups).encode()).hexdigest()
        rows.append((doc, len(found[0]), len(found[1]), len(groups), len(links), best, sum(counts[link] for link in links), digest))
    return sorted(rows, key=repr)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog."),
    (2, "the quick  brown\tfox\n\njumps"),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "<|endoftext|> <s> </s> <0x41> plain"),
    (7, "日本語 \U0001f600\U0001f600 naïve ́​ ▁ mark"),
    (8, "x" * 3000),
    (9, "=" * 700 + " " * 300 + "1234567890" * 40),
    (10, "The quick brown fox jumps over the lazy dog."),
    (10, "The quick brown fox jumps over the lazy dog."),
    (None, "don't we'll\r\nthey've"),
    (11, "a\x00b \x85 \xa0 c"),
    (12, "word " * 30_000),
]


def _result(spark, docs, **more):
    found, pairs = t.align_tokens(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **more)
    return sorted((tuple(row) for row in found.select(*NAMES).collect()), key=repr), pairs


def test_texts_of_all_kinds(spark, plain):
    expected = brute(DOCS, plain)
    got, pairs = _result(spark, DOCS)
    assert got == expected
    # Sent in several blocks, the counts are the same.
    assert _result(spark, DOCS, pairs_per_block=20)[0] == expected
    assert pairs.where("best").select("first").distinct().count() == pairs.select("first").distinct().count()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text_is_cut_like_the_whole(plain, text):
    tok = t.tokenizers(FIRST, SECOND)
    found, ids = plain(text), tok.encode(text)
    assert (ids is None) == (found is None)
    if found:
        assert ids == ([x for x, _ in found[0]], [x for x, _ in found[1]])
        [got] = t.aligned_texts([text], t.Windows(tok))
        groups = _groups(*found)
        assert got["n_groups"] == len(groups)
        assert got["groups_sha256"] == hashlib.sha256(_shown(groups).encode()).hexdigest()
        links = Counter(a * len(tok.second_sizes) + b for own, other in groups for a in own for b in other)
        codes, counts = t.unpacked(got["pairs"])
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == dict(links)


def test_windows_are_remembered_and_forgotten(monkeypatch):
    tok = t.tokenizers(FIRST, SECOND)
    known = t.Windows(tok)
    once = t.aligned_texts(["one two three " * 50, None, "two"], known)
    assert len(known.numbers) < 10
    again = t.aligned_texts(["two", "one two three " * 50], known)
    assert [once[2], once[0]] == again
    monkeypatch.setattr(t, "_MEMO_WINDOWS", 1)
    assert t.aligned_texts(["two", "one two three " * 50], known) == again
    # Many tokens without a common end are counted, not listed.
    monkeypatch.setattr(t, "_LISTED_LINKS", 0)
    assert t.aligned_texts(["two", "one two three " * 50], t.Windows(tok)) == again


def test_pairs_pack_and_unpack():
    for codes in ([0], [5, 6, 1 << 33], list(range(0, 9000, 7))):
        links = np.arange(1, len(codes) + 1)
        got = t.unpacked(t.packed(np.array(codes), links))
        assert got[0].tolist() == codes and got[1].tolist() == links.tolist()


def test_empty_table_and_clashing_columns(spark):
    found, pairs = t.align_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert found.count() == 0 and pairs.count() == 0
    odd = spark.createDataFrame([(1, "text", 5, "r", "g")], "doc_id long, text string, N_A int, row string, pair string")
    row = t.align_tokens(odd)[0].first()
    assert (row.doc_id, row.row, row.pair, row.n_groups) == (1, "r", "g", 1)
