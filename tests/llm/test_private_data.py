"""Entities beside numbers that don't belong to them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkweft.llm import surrogates


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("4539 1488 0343 6467 12/27", [("card", "4539 1488 0343 6467")]),
        ("4539148803436467 123", [("card", "4539148803436467")]),
        ("4539-1488-0343-6467 12 27", [("card", "4539-1488-0343-6467")]),
        ("no. 12 4539 1488 0343 6467", [("card", "4539 1488 0343 6467")]),
        ("7 4539148803436467 123", [("card", "4539148803436467")]),
        ("3782 822463 10005 99", [("card", "3782 822463 10005")]),
        ("DE89 3704 0044 0532 0130 00 ABC", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("DE89 3704 0044 0532 0130 02 4539 1488 0343 6467", [("card", "4539 1488 0343 6467")]),
        ("555-123-4567 12345", [("phone", "555-123-4567")]),
        ("999.10.20.30.40", []),
        ("9870157079875996", []),
        ("4539 1488 0343 6467 4539 1488 0343 6467", [("card", "4539 1488 0343 6467")] * 2),
    ],
)
def test_entities_beside_other_numbers(text, wanted):
    assert [(e.kind, text[e.first : e.last]) for e in surrogates.find_entities(text)] == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Mr Łukasz Novák", [("given_m", "Łukasz"), ("surname", "Novák")]),
        ("saw Mr. McDonald's dog", [("surname", "McDonald")]),
        ("Mrs. O'Brien left", [("surname", "O'Brien")]),
        ("Dr. J. Smith", [("surname", "Smith")]),
        ("Frau von der Leyen-Petrović", [("surname", "Leyen"), ("surname", "Petrović")]),
        ("Prof. J. R. van Dijk and Dijk", [("surname", "Dijk"), ("surname", "Dijk")]),
        ("John Smith called Anna Kowalska", [("given_m", "John"), ("surname", "Smith"), ("given_f", "Anna"), ("surname", "Kowalska")]),
        ("John called", []),
        ("Господин Иван Петров", [("given_m", "Иван"), ("surname", "Петров")]),
        ("at 2001:db8::1 now", [("ipv6", "2001:db8::1")]),
        ("fe80::1ff:fe23:4567:890a", [("ipv6", "fe80::1ff:fe23:4567:890a")]),
        ("std::cafe a::b 12:30:45", []),
        ("info@müller.de", [("email", "info@müller.de")]),
        ("写信给a@b.example联系", [("email", "写信给a@b.example")]),
        ("password: hunterhunter", [("secret", "hunterhunter")]),
        ("030 1234567", [("phone", "030 1234567")]),
        ("Bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcdefgh1234", [("secret", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcdefgh1234")]),
        ("王先生 13812345678", [("surname", "王"), ("phone", "13812345678")]),
        ("找李小明女士谈", [("surname", "李小明")]),
    ],
)
def test_entities_in_other_forms(spark, text, wanted):
    assert [(e.kind, text[e.first : e.last]) for e in surrogates.find_entities(text)] == wanted
    may = spark.createDataFrame([(text,)], "t string").select(surrogates.may_hold(F.col("t"))).head()[0]
    assert may or not wanted


def test_surrogates_keep_the_calling_code_and_form():
    for written, start in (("+49 30 1234567", "+49 "), ("+1 (555) 123-4567", "+1 ("), ("+353 1 234 5678", "+353 ")):
        (entity,) = surrogates.find_entities(written)
        new = surrogates.written_like("phone", written, surrogates.surrogate(entity.kind, entity.value, 0, b"k"))
        assert new.startswith(start) and len(new) == len(written) and new != written
    assert len(surrogates.surrogate("surname", "李小明", 0, b"k")) == 3
    assert surrogates.surrogate("secret", "eyJabc.def", 0, b"k").startswith("eyJ")


def test_short_entities_do_not_run_out_of_surrogates(spark):
    rows = [("email", f"{a}@{b}.example") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    found = surrogates.assign_surrogates(spark.createDataFrame(rows, "kind string, value string"), b"key").collect()
    old, new = {r["value"] for r in found}, {r["new"] for r in found}
    assert len(found) == len(old) == len(new) == len(rows) and not old & new
