from __future__ import annotations

import random
import re
import string

import pytest

from opsgauge.llm.secret_scan import find_spans, listed, novelty, secrets

HEX = "0123456789abcdef"


def expected_base(text):
    found = []
    pattern = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, (name, rule, size, group) in enumerate(
        [("assign", pattern, 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)]
    ):
        found += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(rule, text or "") if len(m[group]) >= size]
    return ",".join(x for _, _, x in sorted(found))


def sample(seed):
    rng = random.Random(seed)
    pieces = ["token = ", 'PassWord: "', "api_key=", "apikey ='", "secret:", "AKIA", "ſecret=", "été ", "the ", "\n", "passwd", "=", "日本"]
    texts = []
    for _ in range(150):
        text = ""
        for _ in range(rng.randint(0, 12)):
            text += rng.choice(pieces)
            text += "".join(rng.choices(rng.choice([HEX, string.ascii_uppercase + "0123456789", "ab_./ "]), k=rng.choice([0, 4, 6, 17, 24, 40])))
        texts.append(text)
    return texts + [None, ""]


def test_base_spans_equal_the_patterns(spark):
    texts = sample(1)
    rows = spark.createDataFrame([(at, text, 1) for at, text in enumerate(texts)], "doc_id bigint, text string, secrets int")
    found = secrets(rows)
    found = found.select("doc_id", "text", listed(found.secrets, ("assign", "access", "hex")).alias("base"), "secrets").collect()
    assert len(found) == len(texts)
    for row in found:
        assert row.base == expected_base(row.text)
        base = [(s.start, s.end) for s in row.secrets if s.kind != "novel"]
        for span in row.secrets:
            if span.kind == "novel":
                assert all(span.end <= start or end <= span.start for start, end in base)


def test_novel_strings_near_sensitive_words():
    key = "q7Zt9LmX2vB8nR4kW1sD6"
    text = f"Use the bearer value {key} and session id sessionIdsessionId00 here"
    kinds = {(kind, text[start:end]) for kind, start, end, _ in find_spans(text.encode())}
    assert kinds == {("novel", key)}
    # Far from a sensitive word, repeated nearby, or a word: none.
    assert not find_spans(f"order number {key} was sent".encode())
    assert not find_spans(f"{key} and again: authorization {key} {key}".encode())
    assert not find_spans(b"authorization Donaudampfschifffahrtsgesellschaft")


def test_novelty_is_low_for_what_was_seen():
    assert novelty(b"client_secret_client_id", b"") < 0.6
    assert novelty(b"zK3q9Xw8Lm5Tb2Vn7Rp4", b"some other text") > 0.9


@pytest.mark.parametrize("size", [64, 96, 128, 450, 1024])
@pytest.mark.parametrize(
    "alphabet", [HEX.upper(), string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/"]
)
def test_long_random_keys_are_novel_whatever_their_alphabet(alphabet, size):
    rng = random.Random(size)
    for _ in range(20):
        key = "".join(rng.choices(alphabet, k=size))
        text = f"The header is Authorization: Bearer {key} and more text follows"
        assert [(kind, text[start:end]) for kind, start, end, _ in find_spans(text.encode())] == [("novel", key)]
        # What repeats inside a long string is not new.
        assert novelty((key[:32] * 20).encode(), b"") < 0.5


def test_empty_table_and_long_text(spark):
    rows = spark.createDataFrame([], "text string")
    assert secrets(rows).count() == 0
    long = "word " * 300_000 + 'token = "' + "ab12" * 10 + '"'
    row = secrets(spark.createDataFrame([(long,), (long,)], "text string")).first()
    assert [(s.kind, s.start) for s in row.secrets] == [("assign", 1_500_000), ("hex", 1_500_009)]
