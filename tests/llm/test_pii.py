import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from recollect.llm import pii, queries

TEXTS = [
    "Write to Anna.Smith@mail.example.org or call +1 (017) 555-7713.",
    "ANNA.SMITH@MAIL.EXAMPLE.ORG wrote; card 4111 1111 1111 1111, again 4111111111111111.",
    "Host 10.20.130.4, id 123-45-6789, IBAN DE89 3704 0044 0532 0130 00, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"",
    "Mrs. Clara Weber met Mr. Weber and Dr Novak. Later Mr. John Weber left. Госпожа Иванова пришла.",
    "Nothing here, 12 apples and version 1.2.3.",
]


def run(spark, texts=TEXTS, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.replace_pii(df, key).orderBy("doc_id").collect()]


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_forms(spark):
    a, b, c, d, e = run(spark)
    assert e == TEXTS[4]
    mail = re.search(r"[\w.]+@[\w.]+\w", a).group()
    assert mail != "Anna.Smith@mail.example.org" and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{4}@[a-z]{4}\.[a-z]{7}\.org", mail)
    assert mail.upper() in b and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.$", a) and "017" not in a
    spaced, plain = re.search(r"\d{4} \d{4} \d{4} \d{4}", b).group(), re.search(r"\d{16}", b).group()
    assert spaced.replace(" ", "") == plain != "4111111111111111" and plain[0] == "4" and luhn(plain) % 10 == 0
    ip = re.search(r"Host (\d+)\.(\d+)\.(\d+)\.(\d+),", c)
    assert [len(g) for g in ip.groups()] == [2, 2, 3, 1] and all(int(g) < 256 for g in ip.groups())
    assert re.search(r"id \d{3}-\d{2}-\d{4}, IBAN DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, token = \"[0-9a-f]{40}\"", c)
    m = re.fullmatch(r"Mrs\. (\w+a) (\w+) met Mr\. (\w+) and Dr (\w+)\. Later Mr\. (\w+n) (\w+k) left\. Госпожа ([А-Я][а-я]+) пришла\.", d)
    assert m and m[2] == m[3] == m[6] != "Weber" and m[7] != "Иванова" and m[4] != "Novak"


def test_key_and_repeat(spark):
    assert run(spark) == run(spark) != run(spark, key="other")


def plain_permuted(key, values, sizes):
    """What ``pii.permuted`` does, value by value."""

    def turn(v, r, sign):
        half = len(v) // 2
        other = v[half:] if r % 2 == 0 else v[:half]
        seed = f"{key}\x1f{r}\x1f" + ",".join(map(str, other))
        out = list(v)
        for i in range(half) if r % 2 == 0 else range(half, len(v)):
            digest = hashlib.sha256(f"{seed}\x1f{i // 16}".encode()).hexdigest()
            out[i] = (v[i] + sign * int(digest[i % 16 * 4 :][:4], 16)) % sizes[i]
        return out

    for r in range(pii.ROUNDS):
        values = turn(values, r, 1)
    first = next((i for i, n in enumerate(sizes) if n > 1), None)
    if first is not None:
        values[first] = (values[first] + 1) % sizes[first]
    for r in reversed(range(pii.ROUNDS)):
        values = turn(values, r, -1)
    return values


@pytest.mark.parametrize("sizes", [[10], [2, 3], [10, 1, 26], [10] * 3, [1, 1]])
def test_permuted_is_one_to_one_on_the_whole_space(spark, sizes):
    every = [list(v) for v in itertools.product(*map(range, sizes))]
    rows = spark.createDataFrame([(v, sizes) for v in every], "v array<int>, n array<int>")
    got = [(r["v"], r["p"]) for r in rows.select("v", pii.permuted(F.lit("key"), F.col("v"), F.col("n")).alias("p")).collect()]
    assert sorted(p for _, p in got) == every
    assert all(p == plain_permuted("key", v, sizes) and (p != v or max(sizes) == 1) for v, p in got)


def test_long_values(spark):
    v, n = [i * 7 % 26 for i in range(100)], [26] * 100
    got = spark.createDataFrame([(v, n)], "v array<int>, n array<int>").select(pii.permuted(F.lit("key"), F.col("v"), F.col("n")).alias("p")).first()["p"]
    assert got == plain_permuted("key", v, n)


def test_dense_form(spark):
    """All addresses of one-digit octets, ten thousand: distinct, none unchanged, the same set again."""
    texts = [f"server {a}.{b}.{c}.{d} up" for a, b, c, d in itertools.product(range(10), repeat=4)]
    out = run(spark, texts)
    assert sorted(out) == sorted(texts) and not any(a == b for a, b in zip(out, texts))


def test_nothing_leaks(spark):
    mail, token = "a" * 90 + "@mail.org", "0f" * 80
    texts = [
        f"{mail} {token} +48 600 700 800 and +48600700800", "2001:db8::ff00:42:8329 and fe80:0:0:0:1:2:3:4 at 12:30:45, std::cout",
        "Mr John Paul Smith, Mr McDonald, Mr O'Neil's dog, Señora María de la Cruz and Herr von Weber-Haus", "Prof. Dr. Weber\nand Mr J. R. Tolkien", "MR2 is a car, Mr. is not; 300.1.1.1 and 1.2.3",
    ]
    out = run(spark, texts)
    for gone in (mail, token, "600 700", "600700", "db8", "fe80", "John", "Paul", "Smith", "McDonald", "Neil", "María", "Cruz", "Weber", "Haus", "Tolkien"):
        assert not any(gone in t for t in out), gone
    spaced, joined = re.fullmatch(r"\w+@\w+\.org \w{160} \+48 (\d{3} \d{3} \d{3}) and \+48(\d{9})", out[0]).groups()
    assert spaced.replace(" ", "") == joined and out[1].endswith(" at 12:30:45, std::cout")
    assert re.fullmatch(r"Mr \w+n \w+n \w+k, Mr \w+k, Mr \w+k's dog, Señora \w+a de la \w+k and Herr von \w+n-\w+k", out[2])
    assert re.fullmatch(r"Prof\. Dr\. (\w+)\nand Mr [A-Z]\. [A-Z]\. \w+", out[3]) and out[4] == texts[4]


def test_letters_beyond_16_bits(spark):
    """Two addresses that differ in such letters only stay two, and keep these letters."""
    texts = ["𝐀𝐛@mail.org wrote", "𝐁𝐛@mail.org wrote", "😀 a@b.org 😀"]
    a, b, c = run(spark, texts)
    assert a != b and a.startswith("𝐀𝐛@") and b.startswith("𝐁𝐛@") and "mail" not in a and c[0] == c[-1] == "😀" and c != texts[2]


def test_national_forms(spark):
    texts = [
        "06 12 34 56 78 or 600 700 800", "020 7946 0958 and (02) 1234 5678", "Signora Rossi, Sr. Pérez, Sra. Gómez and Sir Walter", "de89 3704 0044 0532 0130 00",
        "Bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.SflKxwRJSMeKKF2QT4 sent", "see https://bob:pw@host/x and mailto:ann@mail.org",
    ]
    out = run(spark, texts)
    for gone in ("34 56", "600 700", "7946", "1234 5678", "Rossi", "Pérez", "Gómez", "Walter", "3704", "zdWIi", "SflKx", "bob:pw", "ann@mail"):
        assert not any(gone in t for t in out), gone
    assert re.fullmatch(r"\d\d( \d\d){4} or \d{3} \d{3} \d{3}", out[0]) and re.fullmatch(r"\d{3} \d{4} \d{4} and \(\d\d\) \d{4} \d{4}", out[1])
    assert re.fullmatch(r"Signora \w+k, Sr\. \w+k, Sra\. \w+k and Sir \w+k", out[2]) and re.fullmatch(r"de\d\d( \d{4}){4} \d\d", out[3])
    assert re.fullmatch(r"Bearer eyJ[\w-]+\.[\w-]+\.[\w-]+ sent", out[4]) and re.fullmatch(r"see https://\w{3}:\w\w@host/x and mailto:\w{3}@\w{4}\.org", out[5])


def test_what_is_no_account(spark):
    texts = ["part AB12 CDEF GHIJ KLMN fits", "DE89 3704 0044 0532 0130 00 and de89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE00 3704 0044 0532 0130 00"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(df, "k").collect()}
    assert got[0]["text"] == texts[0] and got[0]["n_entities"] == 0
    spaced, joined = got[1]["text"].split(" and ")
    assert spaced.replace(" ", "").lower() == joined != "de89370400440532013000" and got[1]["n_entities"] == 2
    number = lambda t: int("".join(str(int(c, 36)) for c in t.replace(" ", "")[4:] + t.replace(" ", "")[:4]))
    assert number(spaced) % 97 == 1 and number(got[2]["text"]) % 97 == 1 and got[2]["text"].startswith("GB")
    assert got[3]["text"] != texts[3]


def test_one_person_under_several_titles(spark):
    out = run(spark, ["Dr Anna Smith", "Ms Anna Smith", "Prof. Dr. Anna Smith", "Mr Anna Smith", "Ms Smith", "Dr Kim Lee"])
    bare = [re.sub(r"^(?:Dr|Ms|Mr|Prof\.) (?:Dr\. )?", "", t) for t in out]
    assert bare[0] == bare[1] == bare[2] != bare[3] and bare[0].endswith(" " + bare[4]) and bare[0].split()[0].endswith("a") and bare[3].split()[0].endswith("n")


def test_names_that_draw_the_same_differ(spark, monkeypatch):
    """With two syllables to draw from, most words collide."""
    monkeypatch.setitem(pii.SOUNDS, "latin", ("b", "ae", "a", "n", "i"))
    names = [f"{a}{b}{c}x" for a in "ABCDEFG" for b in "abcdefg" for c in "abc"] + ["Bababak"]
    out = run(spark, [f"Mr {n} left" for n in names])
    assert len(set(out)) == len(names) and not set(out) & {f"Mr {n} left" for n in names}


def test_checks_stay_as_they_are(spark):
    rows = [("card", "4111111111111111"), ("card", "4111111111111112"), ("iban", "DE89370400440532013000"), ("iban", "GB29NWBK60161331926819"), ("iban", "DE00370400440532013000")]
    got = {r["canon"]: r["surrogate"] for r in pii.surrogates(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()}
    mod = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    assert luhn(got["4111111111111111"]) % 10 == 0 != luhn(got["4111111111111112"]) % 10
    assert [mod(got[c]) == 1 for _, c in rows[2:]] == [True, True, False] and got["GB29NWBK60161331926819"][4:8].isupper()


def test_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pattern = re.compile(r"[\w.]+@[\w.]+\w|(?<![\d.])\d+\.\d+\.\d+\.\d+|\+1 \(\d+\) \d+-\d+|\b\d{16}\b|\b[0-9a-f]{40}\b")
    found, seen = 0, {}
    for r in queries.op5_surrogates(spark, sf).collect():
        old, new = pattern.findall(docs[r["doc_id"]]), pattern.findall(r["text"])
        assert len(old) == len(new) and pattern.sub("#", docs[r["doc_id"]]) == pattern.sub("#", r["text"])
        found += len(old)
        for a, b in zip(old, new):
            assert a != b and seen.setdefault(a.lower(), b.lower()) == b.lower()
    assert found > 5 and len(set(seen.values())) == len(seen)


def test_odd(spark, odd):
    out = pii.replace_pii(odd("n_entities"), "k")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_entities"]
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in out.collect()) == sorted((repr(r["doc_id"]), repr(r["text"])) for r in odd().collect())
    assert pii.replace_pii(odd(rows=[]), "k").count() == 0
    same = [(7, "mail a@b.org now", "en", "a", 1, "x"), (7, "mail a@b.org now", "en", "a", 1, "x"), (None, "mail a@b.org now", "en", "a", 1, "x")]
    assert len({r["text"] for r in pii.replace_pii(odd(rows=same), "k").collect()}) == 1
    long = [(1, "x" * 200000 + " a@b.org " + "1." * 50000, "en", "a", 1, "x")]
    assert "a@b.org" not in pii.replace_pii(odd(rows=long), "k").first()["text"]
