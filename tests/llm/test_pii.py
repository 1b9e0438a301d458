"""Kinds of personal data, and formats that the corpus fills."""

import re

import pytest

from shelfmark.llm import pii


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("pay to GB82 WEST 1234 5698 7654 32 or DE89370400440532013000", ["iban", "iban"]),
        ("pay to GB83 WEST 1234 5698 7654", []),
        ("number 123-45-6789, not 000-45-6789 or 123-00-6789", ["ssn"]),
        ("host 2001:db8::8a2e:370:7334 at 12:30:45", ["ip6"]),
        ("std::vector and a::b and 10:20", []),
        ("from 10.0.0.1 to FE80:0:0:0:0:0:0:1.", ["ip", "ip6"]),
    ],
)
def test_kinds(text, kinds):
    assert [k for _, _, k, _ in pii.entities(text)] == kinds


def test_surrogates_are_of_the_kind_and_layout():
    for text in ("GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "123-45-6789", "2001:db8::8a2e:370:7334"):
        (start, end, kind, value), = pii.entities(text)
        new = pii.laid_out(text[start:end], kind, pii.surrogate(kind, value))
        assert new != text and [e[2] for e in pii.entities(new)] == [kind]
        if kind != "ip6":
            assert [re.sub("[A-Z]", "A", re.sub(r"\d", "0", x)) for x in (text, new)][0] == re.sub("[A-Z]", "A", re.sub(r"\d", "0", new))
    assert pii.entities("FE80:0:0:0:0:0:0:1")[0][3] == pii.entities("fe80::1")[0][3]


@pytest.mark.parametrize("size", [2, 3, 10, 1000])
def test_permutation_and_its_inverse(size):
    there = [pii.permute(n, size, "k", "w") for n in range(size)]
    assert sorted(there) == list(range(size)) and [pii.permute(n, size, "k", "w", back=True) for n in there] == list(range(size))
    moved = [pii.drawn(n, size, "k", "w", pii.FULL) for n in range(size)]
    assert sorted(moved) == list(range(size)) and all(n != m for n, m in enumerate(moved))


def test_full_format_keeps_numbers_apart(spark):
    numbers = [f"+1 {i // 100:02d} {i % 100:02d}" for i in range(0, 10_000, 2)]
    roomy = [f"+1 555 {i:04d} {i:04d}" for i in range(50)]
    texts = [" ; ".join(numbers[i : i + 500]) for i in range(0, len(numbers), 500)] + roomy + [numbers[7]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["text"] for r in pii.replace(rows).collect()}
    new = " ; ".join(found[i] for i in range(10)).split(" ; ")
    assert len(set(new)) == len(numbers) and all(re.fullmatch(r"\+1 \d\d \d\d", x) for x in new)
    assert all(a != b for a, b in zip(new, numbers, strict=True)) and found[len(texts) - 1] == new[7]
    spread = [found[10 + i] for i in range(50)]
    assert len(set(spread)) == 50 and not set(spread) & set(roomy)
