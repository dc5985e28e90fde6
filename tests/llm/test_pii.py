import datetime
import re

from common import ODD, clash, directory, docs, frame, plain
from pyspark.sql import functions as F

from farside.llm import pii


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def run(spark, texts, key="k"):
    return frame(pii.pseudonymise(plain(spark, texts), key))


def cards(n):
    out = []
    for k in range(n):
        body = f"4{k * 7919 % 10**14:014d}"
        out.append(body + next(str(c) for c in range(10) if luhn(body + str(c))))
    return out


def test_feistel_is_a_permutation(spark):
    for a, b in [(1, 36), (7, 9), (10, 10), (92, 397)]:
        df = spark.range(a * b).select(pii.feistel(F.floor(F.col("id") / b), F.col("id") % b, a, b, "d", "k").alias("s"))
        got = {(r.s.l, r.s.r) for r in df.collect()}
        assert got == {(x, y) for x in range(a) for y in range(b)}


def test_cards_stay_valid_and_distinct(spark):
    found = cards(300)
    out = list(run(spark, found).text)
    assert all(luhn(x) and len(x) == 16 and x[0] == "4" for x in out)
    assert len(set(out)) == 300 and sum(a == b for a, b in zip(found, out)) == 0


def test_equal_values_stay_linked_in_any_layout_and_key_matters(spark):
    out = run(spark, ["pay 4111 1111 1111 1111.", "4111111111111111", "x4111-1111-1111-1111"])
    a, b, c = out.text
    assert re.sub(r"\D", "", a) == b and c == "x4111-1111-1111-1111"
    assert run(spark, ["4111111111111111"], "other").text[0] != b
    assert list(out.n_card) == [1, 1, 0]


def test_what_fails_validation_stays(spark):
    same = ["4111111111111112", "300.1.2.3", "1.2.3.4.5", "2021-02-30", "2021-13-01", "666-12-3456", "900-12-3456", "123-00-4567", "31/04/2020", "12345678901234567890", "a@b", "1899-12-31", "v1.2.3"]
    assert list(run(spark, same).text) == same


def test_dates_stay_valid_and_in_their_century(spark):
    first = datetime.date(1995, 1, 1)
    days = [first + datetime.timedelta(k) for k in range(0, 4000, 3)]
    iso = run(spark, [d.isoformat() for d in days])
    new = [datetime.date.fromisoformat(x) for x in iso.text]
    assert len(set(new)) == len(days) and all((a.year < 2000) == (b.year < 2000) for a, b in zip(days, new)) and iso.n_date.sum() == len(days)
    for layout in ("%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y"):
        out = list(run(spark, [d.strftime(layout) for d in days]).text)
        assert len(set(out)) == len({d.strftime(layout) for d in days})
        for d, x in zip(days, out):
            both = d.day <= 12
            back = datetime.datetime.strptime(x, layout)
            assert (back.year < 2000) == (d.year < 2000) and (back.day <= 12) == both
    leap = run(spark, ["29.02.2004", "29/02/1996", "1/2/2020"])
    assert all(datetime.datetime.strptime(x, f) for x, f in zip(leap.text, ("%d.%m.%Y", "%d/%m/%Y", "%d/%m/%Y")))


def test_other_kinds(spark):
    texts = ["123-45-6789", "10.0.0.255", "+1 (988) 555-2485", "(212) 555-0100", "+44 20 7946 0958", "Jo.Do_e+1@mail.example.com", "+1 (123) 055-2485"]
    out = run(spark, texts)
    a = list(out.text)
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", a[0])
    assert all(0 <= int(p) < 256 for p in a[1].split("."))
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", a[2]) and re.fullmatch(r"\([2-9]\d\d\) [2-9]\d\d-\d{4}", a[3])
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}", a[4]) and re.fullmatch(r"[a-z0-9]{2}\.[a-z0-9]{2}_[a-z0-9]\+[a-z0-9]@mail\.example\.com", a[5])
    assert re.fullmatch(r"\+1 \([01]\d\d\) [01]\d\d-\d{4}", a[6])
    assert all(x != y for x, y in zip(texts[:5], a)) and out[[f"n_{k}" for k in pii.KINDS]].to_numpy().sum() == len(texts)


def test_many_in_one_text_and_plain_parts(spark):
    text = "A 10.0.0.1 b\n+1 (836) 555-9331 4913187196670932 53.121.55.90 end é 4111111111111111, x@y.zz!"
    r = run(spark, [text]).iloc[0]
    assert re.fullmatch(r"A [\d.]+ b\n\+1 \(\d{3}\) \d{3}-\d{4} \d{16} [\d.]+ end é 4\d{15}, [a-z0-9]@y\.zz!", r.text)
    assert (r.n_phone, r.n_ipv4, r.n_email) == (1, 2, 1) and r.n_card == 1 + luhn("4913187196670932")


def test_odd_rows_and_plan(spark, tmp_path):
    rows = [*ODD, ODD[3], (8, "\u0001\u0003 4111111111111111 \u0001\u0002", "en", "s", 1), (9, "4111111111111111 " * 5000, "en", "s", 1)]
    df = clash(docs(spark, rows), "n_card", "_pieces", "value")
    out = pii.pseudonymise(df, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*df.columns, "_n_card", *(f"n_{k}" for k in pii.KINDS[1:])]
    assert got[1].text is None and got[2].text == "" and got[3].text == ODD[2][1] and got[5].text == ODD[5][1]
    assert re.fullmatch("\u0001\u0003 4\\d{15} \u0001\u0002", got[8].text) and got[9]._n_card == 5000 and len(set(got[9].text.split())) == 1
    plan = pii.op5_pii(spark, directory(tmp_path, documents=docs(spark, rows)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert pii.pseudonymise(plain(spark, []), "k").count() == 0


def test_numbers_abroad_are_replaced_to_their_last_digit(spark):
    texts = ["+33 1 42 68 53 00", "+33 1 42 68 53 01", "+49 30 12 34 56 78", "+49 30 12 34 56 79", "+44 (0) 20 7946 0958", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5"]
    out = run(spark, [f"call {t} now" for t in texts])
    for t, x in zip(texts, out.text):
        assert re.fullmatch("call " + re.escape(re.match(r"\+\d+", t)[0]) + re.sub(r"\d", r"\\d", re.escape(t[len(re.match(r"\+\d+", t)[0]) :])) + " now", x) and t not in x
    assert list(out.n_phone) == [1] * len(texts) and out.text.nunique() == len(texts)
    card = run(spark, ["+44 20 7946 0958 4111 1111 1111 1111", "+12 3 4"])
    assert list(card.n_phone) == [1, 0] and "0958" not in card.text[0] and card.text[1] == "+12 3 4"


def test_feistel_against_a_slow_network(spark):
    """The permutation of pairs by plain integers and hashlib."""
    import hashlib

    def slow(left, right, a, b, domain, key):
        for k in range(pii.ROUNDS):
            mix = lambda half: int(hashlib.sha256(f"{key}|{domain}|{k}|{half}".encode()).hexdigest()[:14], 16)  # noqa: B023, E731
            if k % 2 == 0:
                left = (left + mix(right) % a) % a
            else:
                right = (right + mix(left) % b) % b
        return left, right

    for a, b in ((7, 11), (65536, 65536), (898, 99 * 9999)):
        df = spark.createDataFrame([(k * 7919 % a, k * 104729 % b) for k in range(60)], "x long, y long")
        got = df.select("x", "y", pii.feistel(F.col("x"), F.col("y"), a, b, "some", "key").alias("p")).collect()
        assert all((r.p.l, r.p.r) == slow(r.x, r.y, a, b, "some", "key") for r in got)


def test_without_a_key_outside_local_mode_a_secret_one_is_drawn(spark, tmp_path, monkeypatch):
    found = [*cards(40), cards(1)[0]]
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    out = list(frame(pii.op5_pii(spark, directory(tmp_path, documents=plain(spark, found))).orderBy("doc_id")).text)
    assert len(set(out)) == 40 and out[0] == out[-1] and all(luhn(x) for x in out) and not set(out) & set(found)
    key = pii.query_key(spark)  # the same for all of an application's results
    assert len(key) == 64 and out == list(run(spark, found, key).text)
    monkeypatch.setattr(pii, "_drawn", {})
    assert pii.query_key(spark) not in (key, pii.TEST_KEY)
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        assert pii.query_key(spark) == "own"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    monkeypatch.undo()
    assert pii.query_key(spark) == pii.TEST_KEY


def test_hosts_of_any_number_of_labels(spark):
    """A host ends behind its last dot before two letters, however many labels it has."""
    many = "b." * 20_000
    out = run(spark, [f"x jo@{many}com y", f"x jo@{many}com.{many}1 y", f"x jo@{many}1 y"])
    assert re.fullmatch(r"x [a-z0-9]{2}@" + re.escape(many) + "com y", out.text[0]) and out.text[0] != f"x jo@{many}com y"
    assert re.fullmatch(r"x [a-z0-9]{2}@" + re.escape(f"{many}com.{many}1 y"), out.text[1]) and out.text[2] == f"x jo@{many}1 y"
    assert list(out.n_email) == [1, 1, 0]


def test_hosts_end_as_by_a_plain_pattern(spark):
    import random

    plainly = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
    r = random.Random(5)
    texts = ["".join(r.choices("ab1-._@ ", (6, 6, 2, 1, 6, 1, 3, 1), k=r.randrange(4, 40))) for _ in range(4000)]
    df = plain(spark, texts).select("doc_id", F.regexp_replace("text", "(?<![A-Za-z0-9])" + pii.EMAIL, "<$0>").alias("x")).orderBy("doc_id")
    assert [x.x for x in df.collect()] == [plainly.sub(r"<\g<0>>", t) for t in texts]
    assert sum("<" in plainly.sub("<", t) for t in texts) > 300
