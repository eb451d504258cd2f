"""The guess-cost program against a table of all spans, and words learned from the corpus."""

import math
import random
import re

import pytest

from cwlight.llm import secrets
from tests.llm.edge import CLASH, documents

KNOWN = secrets.ranks(["door", "refrigerator", "bridge", "ox", "pie"])


def span_bits(value, i, j):
    """The least cost of value[i:j] as one span, from the definitions of the kinds."""
    s, low = value[i:j], value[i:j].lower()
    n, costs = j - i, [sum(map(secrets._alphabet, s))]
    pairs = list(zip(low, low[1:]))
    deltas = {ord(b) - ord(a) for a, b in pairs}
    head = secrets._alphabet(s[0]) + math.log2(n)
    if n >= 3 and len(set(low)) == 1:
        costs.append(3 + head)
    if n >= 3 and all(p in secrets.NEXT for p in pairs):
        costs.append(6 + head)
    if n >= 3 and deltas in ({1}, {-1}):
        costs.append(4 + head)
    if n >= 4 and all(secrets.usual(a, b) for a, b in pairs):
        costs.append(6 + 1.45 * n)
    if s in ("-", "_", ".", "/"):
        costs.append(2.0)
    year, month, day, sep = r"(19|20)[0-9]{2}", "(0[1-9]|1[0-2])", r"(0[1-9]|[12][0-9]|3[01])", "[-/._]?"
    if any(re.fullmatch(p, s) for p in (year, year + sep + month + sep + day, day + sep + month + sep + year)):
        costs.append(math.log2(365 * 120))
    for form, times in ((low, 1), (low.translate(secrets.LEET), 8)):
        if n >= 3 and form in KNOWN:
            case = 0 if s == low else 1 if s in (low.upper(), low.capitalize()) else n
            costs.append(math.log2(KNOWN[form] * times + 1) + case)
    if n >= 2 and value[i - n : i] == s and i >= n:
        costs.append(math.log2(2 * n))
    return min(costs)


def brute(value):
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + 1 + span_bits(value, i, j) for i in range(j)))
    return best[-1]


FIXED = ["internationalization2", "refrigerator-door", "P4ssword2019-12-24", "aaaabcdefqwertz", "20200131x1999", "abcabcabcabc", "dcbazyx987", "bridge/door_pie", "SuMMer", "aab12aab12", "Straße-Größe", "zzzzzzzzzzzzzzzz1234"]


@pytest.mark.parametrize("value", FIXED)
def test_cost_is_the_least_over_all_segmentations(value):
    assert secrets.guess_bits(value, KNOWN) == pytest.approx(brute(value), abs=1e-9)


def test_cost_of_random_mixtures_is_the_least():
    rng = random.Random(4)
    parts = ["door", "Pie", "d00r", "qwert", "asdf", "aaa", "1111", "abcd", "4321", "2021", "19991231", "01-02-2003", "x", "Z", "7", "!", "é", "bridge", "zx", "abab"]
    for _ in range(300):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        assert secrets.guess_bits(value, KNOWN) == pytest.approx(brute(value), abs=1e-9), value


def test_an_early_end_decides_alike():
    rng = random.Random(5)
    for _ in range(300):
        value = "".join(rng.choice("abcdefgh0123456789-qwerty") for _ in range(rng.randrange(6, 30)))
        for enough in (20.0, 42.0):
            assert (secrets.guess_bits(value, KNOWN, enough) >= enough) == (secrets.guess_bits(value, KNOWN) >= enough), value


def test_long_values_take_time_in_proportion():
    assert secrets.guess_bits("a" * 20_000, KNOWN) < 30
    noise = "".join(random.Random(1).choices("abcdefghijkmnpqrstuvwxyz23456789", k=1_000_000))
    assert len(secrets.guessed_spans(f"secret key: {noise}")) == 1


def values(text, known):
    return [text[a:b] for a, b, _ in secrets.guessed_spans(text, known=known)]


def test_prose_and_addresses_are_no_secrets():
    for text in ("auth: refrigerator-door", "pin: https://example.org/a/page", "token: internationalization2"):
        assert values(text, secrets.RANK) == [], text
    assert values("pin: https://user:x7Gq!9zLp0Rt@example.org/a", secrets.RANK) == ["https://user:x7Gq!9zLp0Rt@example.org/a"]


def test_words_come_from_the_corpus(spark):
    rows = [(i, f"Zorblax, zorblax (quindor) and pass7word {i}") for i in range(6)] + [(9, "rarely seen"), (10, None), (None, "zorblax")]
    docs = documents(spark, rows)
    assert secrets.frequent_words(docs) == ["zorblax", "and", "quindor"]
    assert secrets.frequent_words(docs, most=1) == ["zorblax"] and secrets.frequent_words(docs.limit(0)) == []
    value = "zorblaxquindorzorblaxquindor"
    assert values(f"pwd: {value}x", secrets.RANK) and not values(f"pwd: {value}x", secrets.ranks(["zorblax", "and", "quindor"]))


def test_rows_of_odd_documents(spark):
    secret = "x7Gq!9zLp0Rt"
    rows = [(1, f"DB_PWD={secret} token=abcdef0123"), (1, f"DB_PWD={secret} token=abcdef0123"), (2, None), (None, f"pwd: {secret}"), (3, "")]
    got = sorted(((r.doc_id, r.n_assign, r.n_guess, r.spans) for r in secrets.scan(documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, 1, "guess:7:19,assign:20:36")] * 2 + [(2, 0, 0, ""), (3, 0, 0, ""), (None, 0, 1, "guess:5:17")], key=repr)
    assert CLASH and secrets.scan(documents(spark, [])).count() == 0
