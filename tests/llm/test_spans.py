import hashlib
import random
import re

from cwlight.llm import pii, secrets
from cwlight.llm.queries import QUERIES
from tests.llm.edge import documents

#: The base patterns as they are stated, with the checks behind them.
SECRET = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}
PRIVATE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(re.sub("[ -]", "", m[0])) <= 19 and luhn(re.sub("[ -]", "", m[0]))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def plain(text, kinds):
    found = [(m.start(), list(kinds).index(k), f"{k}:{m.start()}:{m.end()}") for k, (p, ok) in kinds.items() for m in p.finditer(text) if ok(m)]
    return ",".join(s for _, _, s in sorted(found))


def noise(rng, bits):
    return "".join(rng.choice(bits) for _ in range(rng.randrange(60)))


def test_base_spans_equal_the_stated_patterns():
    rng = random.Random(2)
    secret_bits = ["password", "Token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abc123", "zz", "deadbeef", "AKIA", "AKIAIOSFODNN7", "0123456789abcdef", "é", "-", "."]
    private_bits = ["a", "b.c", "@", ".", "x@y.z", "+", "1", "22", "255", "256", "0", " ", "-", "(", ")", "4111", "1111", "+1 (555) 555-0100", "10.0.0.1", "é", "\n"]
    for _ in range(3000):
        t = noise(rng, secret_bits)
        assert secrets.listed(secrets.base_spans(t), secrets.KINDS) == plain(t, SECRET), t
        t = noise(rng, private_bits)
        assert pii.listed(pii.base_spans(t), pii.KINDS) == plain(t, PRIVATE), t


def test_guess_costs_order_passwords():
    cheap = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "2024-01-01", "abcabcabcabc", "PASSWORD", "letmein1"]
    dear = ["x7Gq!9zLp0Rt", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "Zk3#pW9$mQ1@"]
    assert max(map(secrets.guess_bits, cheap)) < secrets.MIN_BITS < min(map(secrets.guess_bits, dear))
    assert secrets.guessed_spans("pwd: x7Gq!9zLp0Rt and pwd: password123") == [(5, 17, "guess")]


def test_guess_cost_is_the_least_over_segmentations():
    """Against a plain search over all cuts, with words and brute force only."""
    import math

    def slow(v, memo={}):  # noqa: B006
        if not v:
            return 0.0
        if v not in memo:
            out = []
            for i in range(1, len(v) + 1):
                bits = sum(map(secrets._alphabet, v[:i]))
                rank = secrets.RANK.get(v[:i])
                out.append(1 + min(bits, math.log2(rank + 1) if rank and i >= 3 else bits) + slow(v[i:]))
            memo[v] = min(out)
        return memo[v]

    for v in ("thexkqpassword", "kxqvz", "adminzqxuser", "welcome"):
        assert abs(secrets.guess_bits(v) - slow(v)) < 1e-9


def test_secret_rows(spark):
    got = {(r.doc_id, r.spans): r for r in secrets.scan(documents(spark, [(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" é'), (2, None), (3, "")]), with_text=True).collect()}
    assert (1, "assign:0:49,hex:9:49,guess:9:49") in got
    one = got[1, "assign:0:49,hex:9:49,guess:9:49"]
    assert one.base_sha256 == hashlib.sha256(b"assign:0:49,hex:9:49").hexdigest() and one.redacted == '[ASSIGN]" é' and (one.n_assign, one.n_access, one.n_hex) == (1, 0, 1)
    assert got[2, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(documents(spark)).count() == 12 and secrets.scan(documents(spark, [])).count() == 0


def test_pii_added_spans_and_redaction(spark):
    texts = ["call 555-123-4567 now", "version 1.2.3.4 of 2024-01-02", "my iban DE89 3704 0044 0532 0130 00 ok", "mail a.b@c.example.com or +1 (743) 555-3824", None]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in pii.find(docs, with_text=True).collect()}
    assert got[0].spans == "phone:5:17" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].spans == "ip:8:15" and got[2].spans.startswith("iban:8:")
    assert got[3].redacted == "mail [EMAIL] or [PHONE]" and got[4].spans == ""
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.where("doc_id = 3").first().text == "mail [EMAIL] or [PHONE]" and out.where("doc_id = 4").first().text is None
    assert out.where("doc_id = 3").first().n_chars == len("mail [EMAIL] or [PHONE]")
    assert pii.find(documents(spark)).count() == 12 and pii.redact(documents(spark, [])).count() == 0


def test_long_runs_take_linear_time():
    import time

    for text in ("1" * 200_000, "a" * 200_000 + "@", "1.2.3." * 50_000, "+1" * 100_000, "password=" * 20_000, "f" * 200_000, "AKIA" * 50_000, "pwd: " * 40_000, "ab12 " * 40_000):
        began = time.time()
        pii.base_spans(text), pii.candidates(text), secrets.base_spans(text), secrets.guessed_spans(text)
        assert time.time() - began < 5, text[:20]


def test_whole_tables_equal_the_stated_patterns(spark, data):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for name, kinds in (("op3_secrets", SECRET), ("op5_pii", PRIVATE)):
        for r in QUERIES[name](spark, data).collect():
            want = plain(docs[r.doc_id], kinds)
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
            assert all(getattr(r, f"n_{k}") == want.count(f"{k}:") for k in kinds)


def test_base_spans_equal_sql(spark, data, oracle, same):
    from cwlight.llm.queries import ORACLE, QUERIES

    for name in ("secrets_base", "pii_base"):
        same(QUERIES[name](spark, data).toPandas(), oracle(ORACLE[name]))
