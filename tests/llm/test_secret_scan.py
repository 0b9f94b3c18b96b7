"""Secret scans: what the thresholds count, and which strings are tested as what."""

import random
import string

from siltstone.llm import secret_scan

BASE64 = string.ascii_letters + string.digits + "+/"


def key(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, texts):
    """Texts of the random spans of each document."""
    rows = {r.doc_id: r.spans for r in secret_scan.scan(docs_of(spark, texts)).collect()}
    return [[texts[i][s.start : s.end] for s in rows[i] if s.kind == "random"] for i in range(len(texts))]


def test_copies_count_once_and_are_all_masked(spark):
    r = random.Random(1)
    secrets = [key(r, BASE64, 40) for _ in range(200)]
    copied = next(k for k in iter(lambda: key(r, BASE64, 40), None) if 0.29 < secret_scan.battery(k)[1] < 0.31)
    once, often = found(spark, [f"a {k} b" for k in (*secrets, copied)]), found(spark, [f"a {k} b" for k in (*secrets, *[copied] * 3000)])
    assert once[200] == [copied] and often[200:] == [[copied]] * 3000
    assert once[:200] == often[:200] and sum(map(bool, often[:200])) >= 0.85 * 200


def test_copies_of_a_likely_string_do_not_let_others_pass(spark):
    r = random.Random(2)
    low = [k for k in iter_keys(r, 0.05, 0.3, 100)]
    likely = next(iter_keys(r, 0.6, 1.1, 1))
    once, often = found(spark, [f"a {k} b" for k in (*low, likely)]), found(spark, [f"a {k} b" for k in (*low, *[likely] * 3000)])
    assert once[:100] == often[:100]


def iter_keys(r, least, most, n):
    while n:
        k = key(r, BASE64, 40)
        if least <= secret_scan.battery(k)[1] < most:
            n -= 1
            yield k


def test_values_after_an_inner_equals_sign_are_tested_alone(spark):
    r = random.Random(3)
    names = ["aws_secret_access_key=", "private_key=", "AccountKey=", "DB_PASS=", "https://x.org/a?sig=", "A_LONG_NAME_OF_A_VARIABLE="]
    values = [k + r.choice(["", "=", "=="]) for k in iter_keys(r, 0.5, 1.1, 60)]
    texts = [f"x {names[i % 6]}{v} y" for i, v in enumerate(values)]
    assert found(spark, texts) == [[v] for v in values]


def test_keys_of_one_case_with_digits_are_as_even_as_those_of_base64():
    r = random.Random(4)
    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    for alphabet in (lower + string.digits, upper + string.digits, lower + "234567", upper + "234567", "0123456789abcdef", BASE64):
        for n in (24, 32, 40, 64):
            p = [secret_scan.battery(key(r, alphabet, n))[1] for _ in range(1000)]
            assert sum(x < 0.05 for x in p) < 80 and sum(x > 0.5 for x in p) > 350
    # words stay out
    for word in ("donaudampfschifffahrtsgesellschaft", "internationalisierungsbehoerde", "a_name_of_several_words", "aaaaaaaaaaaaaaaaaaaaaaaa0"):
        assert secret_scan.battery(word)[1] < 0.05


def test_keys_of_one_case_with_digits_are_found(spark):
    r = random.Random(5)
    keys = [key(r, string.ascii_lowercase + string.digits, 32) for _ in range(200)]
    assert sum(map(bool, found(spark, [f"a {k} b" for k in keys]))) >= 0.85 * 200
