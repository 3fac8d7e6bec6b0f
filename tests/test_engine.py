"""Small cases with results worked out by hand, and random paths against plain loops."""

import datetime as dt
import math
import random
import statistics

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions import finance as fin
from tidemark.functions import text as tx
from tidemark.operators import backtest as bt
from tidemark.operators import dedup, experiments, health, labels, ledger, series, stats
from tidemark.schema import NO_FEES

D = dt.date
FEES = {"buy": 15.0, "sell": 15.0, "tax": 300.0, "slip": 10.0, "borrow": 3650.0, "financing": 730.0}


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_fee_charge(spark):
    charge = lambda delta: one(spark, fin.fee_charge(F.lit(float(delta)), F.lit(1000.0), FEES))
    assert charge(100) == pytest.approx(250)
    assert charge(-100) == pytest.approx(3250)
    assert charge(0) == 0


def test_carry_charge(spark):
    carry = lambda p, c, cash: one(spark, fin.carry_charge(F.lit(float(p)), F.lit(float(c)), F.lit(float(cash)), FEES))
    assert carry(-50, 100, 4981) == pytest.approx(5.0)
    assert carry(10, 100, -10_000) == pytest.approx(2.0)
    assert carry(10, 100, 10_000) == 0


def test_signal_cutoff(spark):
    kst = ["2026-08-25 07:49:00", "2026-08-25 08:50:59", "2026-08-25 08:51:00", "2026-08-24 09:00:00", "2026-08-24 15:30:00", "2026-08-24 23:59:00"]
    x = spark.createDataFrame([(k,) for k in kst], "k string").select((F.to_timestamp("k") - F.expr("INTERVAL 9 HOURS")).alias("utc"))
    got = x.select(fin.kst_date(F.col("utc")).alias("d"), fin.signal_date(F.col("utc")).alias("s")).groupBy("d", "s").count().collect()
    assert {(r["d"].day, r["s"].day): r["count"] for r in got} == {(25, 25): 2, (25, 26): 1, (24, 25): 3}


def flat(spark):
    days = [D(2026, 1, k) for k in (5, 6, 7, 8)]
    prices = spark.createDataFrame([("TST", d, 100.0, 100.0) for d in days], "code string, kst_date date, open double, close double")
    media = spark.createDataFrame([(1, "major")], "media_id long, tier string")
    sd = spark.createDataFrame([("TST", days[0], days[0], 1, 10, 0, 10)], "code string, kst_date date, signal_date date, media_id long, pos long, neg long, doc_cnt long")
    return prices, sd, media


def test_flat_price_backtest(spark):
    prices, sd, media = flat(spark)

    def run(direction, limit, fees):
        return bt.summary(bt.backtest(prices, sd, media, {"major": 5.0}, direction, limit, fees), fees).first()

    long_only = {**FEES, "borrow": 0.0}
    with_carry = run("forward", "long_only", long_only)
    without = run("forward", "long_only", {**long_only, "financing": 0.0})
    assert 3.5 <= with_carry["carry"] <= 4.5
    assert without["net"] - with_carry["net"] == pytest.approx(with_carry["carry"], abs=1)
    short = run("contrarian", "unlimited", FEES)
    assert 18 <= short["carry"] <= 22
    free = run("forward", "long_only", NO_FEES)
    assert free["cost"] == 0 and free["carry"] == 0 and free["net"] == 0


def test_weekend_signal_rolls_forward_and_late_ones_go(spark):
    prices = spark.createDataFrame([("A", D(2024, 1, 5)), ("A", D(2024, 1, 8))], "code string, kst_date date")
    signal = spark.createDataFrame([("A", D(2024, 1, k)) for k in (5, 6, 7, 8, 9)], "code string, signal_date date")
    got = {r["signal_date"].day: r["kst_date"].day for r in bt.assign_trading_day(signal, prices).collect()}
    assert got == {5: 5, 6: 8, 7: 8, 8: 8}


def test_positions_and_cash_match_a_loop(spark):
    rng, rows, want = random.Random(3), [], {}
    for code in "AB":
        position = cash = 0.0
        for k in range(60):
            d, px, raw = D(2024, 1, 1) + dt.timedelta(days=k), rng.choice([0.0, *[rng.uniform(50, 150)] * 9]), float(rng.randint(-5, 5))
            rows.append((code, d, px, px, raw))
            delta = max(0.0, position + (raw if px > 0 else 0)) - position
            rate = 10 + (15 if delta > 0 else 315 if delta < 0 else 0)
            cash -= delta * px + abs(delta) * px * rate / 1e4
            position += delta
            cash -= (max(0, -position) * px * 3650 + max(0, -cash) * 730) / 1e4 / 365
            want[code, d] = (position, cash)
    days = spark.createDataFrame(rows, "code string, kst_date date, open double, close double, raw double")
    for r in bt.simulate(bt.positions(days), FEES).collect():
        assert (r["position"], r["cash"]) == pytest.approx(want[r["code"], r["kst_date"]], abs=1e-6)


def test_coverage_merge(spark):
    def merged(*reports):
        rows = [("TST", "rss", D(2026, 1, 1), run, k, status, n, None) for k, (run, status, n) in enumerate(reports)]
        r = ledger.merge_coverage(spark.createDataFrame(rows, "code string, source string, kst_date date, run int, seq long, status string, doc_count long, last_cursor string")).first()
        return r["status"], r["doc_count"], r["attempts"]

    assert merged((1, "partial", 30), (1, "completed", 40)) == ("partial", 70, 2)
    assert merged((1, "partial", 1), (1, "failed", 0))[0] == "failed"
    assert merged((1, "failed", 0), (1, "completed", 50))[:2] == ("failed", 50)
    assert merged((1, "empty", 0), (1, "completed", 5))[0] == "completed"
    assert merged((1, "failed", 9), (2, "completed", 99))[:2] == ("completed", 99)


def test_label_inheritance(spark):
    cols = "doc_id long, code string, dup_group_id string, is_canonical int, label int, is_relevant int, confidence double, prompt_version string"
    rows = [(1, "A", "g", 1, -1, 0, 0.9, "v2"), (2, "A", "g", 0, None, None, None, None), (3, "A", "g", 0, 1, 1, 0.5, "v1"), (4, "B", "g", 0, None, None, None, None), (5, "A", "h", 1, None, None, None, None), (6, "A", "h", 0, None, None, None, None)]
    got = [tuple(r) for r in labels.inherit(spark.createDataFrame(rows, cols)).collect()]
    assert got == [(2, -1, 0, 0.9, "v2", "inherited")]


def test_near_dedup_links_chains_and_demotes_spam(spark):
    base = "samsungelectronicsrisesonstrongearningsreport"
    rows = [(k, t, a) for k, (t, a) in enumerate([(base, "x"), (base, "x"), (base + "s", "x"), ("completelyotherheadlineaboutoilprices", "x"), ("", None)])]
    x = spark.createDataFrame([("A", D(2024, 1, 1), *r) for r in rows], "code string, kst_date date, doc_id long, norm string, author string")
    got = {r["doc_id"]: (r["dup_group_id"], r["is_canonical"]) for r in dedup.near_dedup(x).collect()}
    assert got[0][1] == 1 and got[1] == (got[0][0], 0)
    assert got[3][1] == 0  # the author's fourth document of the day
    assert got[4] == (None, 1)


def test_text_functions(spark):
    assert one(spark, tx.normalize_title(F.lit("[단독] Samsung!!!! 주가 급등 12"), ("Samsung",))) == "주가급등"
    assert one(spark, tx.registrable(F.lit("www.news.example.co.kr"))) == "example.co.kr"
    assert one(spark, tx.registrable(F.lit("a.b.example.com"))) == "example.com"
    assert one(spark, tx.registrable(F.lit("not a domain"))) is None
    assert one(spark, tx.shingles(F.lit("abcd"))) == ["abc", "bcd"]
    assert one(spark, tx.shingles(F.lit("ab"))) == ["ab"]
    assert one(spark, tx.shingles(F.lit(""))) == []
    assert one(spark, tx.simhash64(F.lit(""))) == 0


def test_simhash_matches_a_loop(spark):
    import hashlib

    for s in ("abcdefgh", "삼성전자주가", "ab"):
        votes = [0] * 64
        for g in [s[k : k + 3] for k in range(len(s) - 2)] or [s]:
            h = int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big")
            for b in range(64):
                votes[b] += 1 if h >> b & 1 else -1
        want = sum(1 << b for b in range(64) if votes[b] > 0)
        assert one(spark, tx.simhash64(F.lit(s))) == (want - (1 << 64) if want >> 63 else want)


def test_weights_are_checked():
    assert fin.parse_weights("major:7,junk")["major"] == 7
    for bad in ("major:-1", "nobody:1", "major:1001", "major:nan"):
        with pytest.raises(ValueError):
            fin.parse_weights(bad)


def test_insert_ignores_known_and_unreadable(spark):
    cols = "doc_id long, code string, source string, url string, title string"
    known = spark.createDataFrame([(1, "A", "s", "u1", "t")], cols)
    new = spark.createDataFrame([(2, "A", "s", "u1", "t"), (3, "A", "s", "u2", "t"), (4, "A", "s", "u2", "t"), (5, "A", "s", None, "t"), (6, "A", "s", None, "t"), (7, "A", "s", "u3", " "), (8, "A", "s", "u4", "a�")], cols)
    assert sorted(r["doc_id"] for r in ledger.insert_documents(new, known).collect()) == [3, 5, 6]


def test_gaps_and_runs(spark):
    p = spark.createDataFrame([("A", D(2024, 1, k)) for k in (1, 2, 3, 4, 5, 8)], "code string, kst_date date")
    s = spark.createDataFrame([("A", D(2024, 1, k)) for k in (1, 4)], "code string, kst_date date")
    assert sorted((r["gap_start"].day, r["gap_end"].day, r["days"]) for r in series.coverage_gaps(p, s).collect()) == [(2, 4, 2), (5, 8, 2)]
    assert sorted((r["run_start"].day, r["run_end"].day) for r in series.contiguous_runs(p, ["code"]).collect()) == [(1, 5), (8, 8)]


def test_empty_bins_are_zero(spark):
    x = spark.createDataFrame([("A", D(2024, 1, 1), 2), ("A", D(2024, 1, 20), 3)], "code string, kst_date date, n long")
    got = {str(r["bin"]): r["n"] for r in series.resample_sum(x, ["code"], ["n"], "weekly").collect()}
    assert got == {"2024-01-05": 2, "2024-01-12": 0, "2024-01-19": 0, "2024-01-26": 3}


def test_correlation_guard(spark):
    x = spark.createDataFrame([("flat", 1.0, float(k)) for k in range(12)] + [("few", float(k), float(k)) for k in range(9)] + [("ok", float(k), -float(k)) for k in range(12)], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in x.groupBy("g").agg(fin.safe_corr(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["flat"] is None and got["few"] is None and got["ok"] == pytest.approx(-1)


def test_health_exit_code(spark):
    ok = health.encoding(spark.createDataFrame([("fine",)], "title string"))
    bad = health.encoding(spark.createDataFrame([("a�",)], "title string"))
    assert health.exit_code(ok).first()[0] == 0
    assert health.exit_code(health.report([ok, bad])).first()[0] == 2


def test_scorer_halves_failing_batches(spark):
    def scorer(channel, items):
        if any(k == 3 for k, _ in items):
            raise RuntimeError
        return [(k, "neutral") for k, _ in items]

    x = spark.createDataFrame([(k, "news", "t") for k in range(8)], "doc_id long, channel string, title string").coalesce(1)
    got = labels.read_labels(labels.score(x, scorer), x).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 4, 5, 6, 7] and {(r["label"], r["is_relevant"]) for r in got} == {(0, 1)}


def test_snapshot_refuses_text_and_empty_tables(spark, tmp_path):
    good = spark.createDataFrame([(1, "x")], "a int, b string")
    assert ledger.snapshot(spark, {"t": good}, str(tmp_path / "s")) == {"t": 1}
    with pytest.raises(ValueError):
        ledger.snapshot(spark, {"t": good.limit(0)}, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        ledger.snapshot(spark, {"t": good.withColumnRenamed("b", "title")}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/t.parquet")).count() == 1


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    with ledger.RunLog(spark, path, "daily") as log:
        log.finish({"n": 1})
    with pytest.raises(RuntimeError), ledger.RunLog(spark, path, "daily"):
        raise RuntimeError("no")
    assert sorted(r["status"] for r in spark.read.parquet(path).collect()) == ["done", "failed", "running", "running"]


def frame(spark, s, ret, code="A"):
    return spark.createDataFrame([(code, D(2024, 1, 1) + dt.timedelta(days=k), x, y) for k, (x, y) in enumerate(zip(s, ret, strict=True))], "code string, kst_date date, net double, ret double")


def test_a_signal_that_leads_by_two_days_has_its_best_lag_at_minus_two(spark):
    rng = random.Random(1)
    s = [rng.uniform(-1, 1) for _ in range(60)]
    lead = frame(spark, s, [0.5, 0.25, *s[:-2]])
    behind = frame(spark, [0.5, 0.25, 0.125, *s[:-3]], s, "B")
    got = {r["code"]: r for r in stats.compare(lead.union(behind)).collect()}
    assert (got["A"]["lag"], got["A"]["r"], got["A"]["n"], got["A"]["z"]) == (-2, 1.0, 58, 7.42)
    changes, after = [b - a for a, b in zip(s, s[1:])][:-2], s[1:-2]  # a change against the return two rows later
    assert got["A"]["diff_r"] == pytest.approx(statistics.correlation(changes, after), abs=1e-4)
    assert (got["B"]["lag"], got["B"]["r"], got["B"]["n"]) == (3, 1.0, 57)
    assert stats.signal_summary(stats.compare(lead.union(behind))).first().asDict() == {"significant": 2, "price_leads": 1, "sentiment_leads": 1}


def test_compare_flags_trend_coverage_and_short_codes(spark):
    rising = frame(spark, [float(k) for k in range(40)], [float(k % 7) for k in range(40)])
    short = frame(spark, [1.0, 2.0] * 10, [2.0, 1.0] * 10, "S")
    coverage = spark.createDataFrame([("A", 1000, 500, 0.5)], "code string, canonical long, labeled long, ratio double")
    got = [r.asDict() for r in stats.compare(rising.union(short), coverage=coverage).collect()]
    assert [r["code"] for r in got] == ["A", "S"]
    assert (got[0]["days"], got[0]["trend_shared"], got[0]["labeled"], got[0]["labeled_ratio"], got[0]["low_coverage"]) == (40, 1.0, 500, 0.5, True)
    assert (got[1]["days"], got[1]["lag"], got[1]["trend_shared"], got[1]["low_coverage"]) == (20, None, None, False)


def test_labels_are_asked_for_by_tier_within_a_code_and_day(spark):
    tiers = ["wire", "blog", "unknown", "online", "daily", "major"]
    assert [r["v"] for r in spark.createDataFrame([(t,) for t in tiers], "t string").select(labels.tier_rank(F.col("t")).alias("v")).collect()] == [5, 4, 3, 2, 1, 0]
    rows = [(k, c, D(2024, 1, 1), ch, t, e) for k, (c, ch, t, e) in enumerate([("A", "news", "wire", 9), ("A", "news", "online", 1), ("A", "cafe", "major", 99), ("B", "cafe", "blog", 1), ("B", "cafe", "blog", None), ("A", "news", "online", 5)])]
    x = spark.createDataFrame(rows, "doc_id long, code string, kst_date date, channel string, tier string, engagement long")
    assert sorted(r["doc_id"] for r in labels.daily_cap(x, 2).collect()) == [1, 3, 4, 5]


def test_replies_are_read_as_models_write_them(spark):
    reply = '[{"id": "1", "label": " Positive ", "relevant": "false", "confidence": "0.7", "why": ""}, {"id": 2, "label": "NEGATIVE", "relevant": 0, "confidence": "high"}, {"id": 3, "label": "neutral", "why": "because"}, {"id": "x", "label": "neutral"}, {"id": 4, "label": "mixed"}, {"id": 9, "label": "neutral"}]'
    wanted = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "doc_id long")
    got = [tuple(r) for r in labels.read_labels(spark.createDataFrame([(reply,)], "reply string"), wanted).orderBy("doc_id").collect()]
    assert got == [(1, 1, 0, 0.7, None), (2, -1, 0, 0.0, None), (3, 0, 1, 0.0, "because")]


def counts(spark):
    sd = spark.createDataFrame([("A", D(2024, 1, 1), 1, 20, 0, 0, 20), ("A", D(2024, 1, 1), 2, 0, 0, 10, 10), ("A", D(2024, 1, 4), 1, 0, 5, 0, 5), ("A", D(2024, 1, 20), 2, 30, 0, 0, 30)], "code string, kst_date date, media_id long, pos long, neu long, neg long, doc_cnt long")
    media = spark.createDataFrame([(1, "one", "major"), (2, "two", "daily")], "media_id long, name string, tier string")
    return sd, media


def test_daily_series_has_only_days_with_documents(spark):
    got = {r["bin"].day: r for r in series.sentiment_series(*counts(spark)).collect()}
    assert sorted(got) == [1, 4, 20]
    # net share times n / (n + 10): (20 - 10) / 30 * 30 / 40, none without opinions, 30 / 40
    assert (got[1]["polarity"], got[4]["polarity"], got[20]["polarity"]) == (pytest.approx(0.25), None, pytest.approx(0.75))
    # logs of 31, 6 and 31 have the mean 2.8866 and the deviation 0.7742
    assert (got[1]["heat"], got[4]["heat"]) == (pytest.approx(0.7071, abs=1e-3), pytest.approx(-1.4142, abs=1e-3))


def test_tiers_have_the_days_of_the_whole(spark):
    got = {(r["tier"], r["bin"].day): (r["doc_cnt"], r["polarity"]) for r in series.sentiment_series(*counts(spark), by="tier").collect()}
    assert {k: v[0] for k, v in got.items()} == {("major", 1): 20, ("major", 4): 5, ("major", 20): 0, ("daily", 1): 10, ("daily", 4): 0, ("daily", 20): 30}
    assert got["major", 20][1] is None and got["daily", 1][1] == pytest.approx(-0.5)
    weekly = {r["bin"].day: r["doc_cnt"] for r in series.sentiment_series(*counts(spark), "weekly", "media", [1]).collect()}
    assert weekly == {5: 25}


def test_imbalance_counts_by_trading_day(spark):
    prices = spark.createDataFrame([("A", D(2024, 1, k)) for k in (2, 3, 4, 5, 8)], "code string, kst_date date")
    signal = spark.createDataFrame([("A", D(2024, 1, k), n) for k, n in ((2, 1), (3, 1), (4, 1), (5, 1), (6, 30), (7, 12), (8, 1))], "code string, signal_date date, doc_cnt long")
    got = [tuple(r) for r in bt.imbalance(bt.assign_trading_day(signal, prices)).collect()]
    assert got == [("A", D(2024, 1, 8), 43, 43.0)]


def test_basket_chains_mean_returns_over_full_days(spark):
    rows = [("A", 1, 10.0, 10.0), ("B", 1, 100.0, 100.0), ("A", 2, 11.0, 12.0), ("B", 2, 100.0, 100.0), ("A", 3, 9.0, 99.0), ("A", 4, 12.0, 6.0), ("B", 4, None, 150.0)]
    x = spark.createDataFrame([(c, D(2024, 1, d), o, p) for c, d, o, p in rows], "code string, kst_date date, open double, close double")
    got = [(r["kst_date"].day, round(r["open"], 6), round(r["high"], 6), round(r["low"], 6), round(r["close"], 6)) for r in stats.basket(x).orderBy("kst_date").collect()]
    # day 2: closes +20 % and 0 %, opens +10 % and 0 %; day 3 lacks B; day 4: closes -50 % and +50 %, A opens unchanged
    assert got == [(1, 100.0, 100.0, 100.0, 100.0), (2, 105.0, 110.0, 105.0, 110.0), (4, 110.0, 110.0, 110.0, 110.0)]


def test_basket_goes_on_beyond_the_range_of_doubles(spark):
    # A and B take turns at 1 and 1000: a mean step of 500.0005 a day
    rows = [(c, D(2024, 1, 1) + dt.timedelta(k), 500.0, 1000.0 if (c == "A") == (k % 2 == 0) else 1.0) for c in "AB" for k in range(200)]
    got = stats.basket(spark.createDataFrame(rows, "code string, kst_date date, open double, close double")).orderBy("kst_date").collect()
    assert [r["log_close"] for r in got] == pytest.approx([math.log(100) + k * math.log(500.0005) for k in range(200)])
    assert [r["log_step"] for r in got] == pytest.approx([0.0] + 199 * [math.log(500.0005)])
    assert [r["opened"] for r in got] == pytest.approx([1.0] + 199 * [250.25 / 500.0005])


def _soaring(tmp_path):
    """A folder whose orders make a basket of three codes, two of which take turns at 1 and 1000, over 300 weekdays."""
    days = [d for d in (D(2024, 1, 1) + dt.timedelta(k) for k in range(420)) if d.weekday() < 5]
    rows = [(3 * k + c, c, float(500 if c == 2 else 1000 if (k + c) % 2 else 1), d) for k, d in enumerate(days) for c in range(3)]
    key, cust, total, day = zip(*rows)
    pq.write_table(pa.table({"o_orderkey": pa.array(key, pa.int64()), "o_custkey": pa.array(cust, pa.int64()), "o_totalprice": pa.array(total, pa.float64()), "o_orderdate": pa.array([dt.datetime(d.year, d.month, d.day) for d in day], pa.timestamp("us"))}), tmp_path / "orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["op_altcoin", "win_cumprod"])
def test_basket_queries_match_their_sql_beyond_the_range_of_doubles(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import QUERIES, SQL

    con, d = duckdb.connect(), _soaring(tmp_path)
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{d}/orders.parquet')")
    query = QUERIES[name](spark, d)
    got = [tuple(r) for r in query.orderBy("kst_date").collect()]
    want = [(day.date() if isinstance(day, dt.datetime) else day, *rest) for day, *rest in con.execute(f"SELECT {', '.join(query.columns)} FROM ({SQL[name]}) ORDER BY kst_date").fetchall()]
    assert len(got) == len(want) == 300
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(g[1:] == pytest.approx(w[1:], abs=2e-7) for g, w in zip(got, want))


MEDIA = "media_id long, name string, domain string, tier string, channel string"
RULES = "rule int, tier string, canonical string, aliases array<string>, channel string"


def test_outlets_are_merged_by_the_first_rule(spark):
    media = spark.createDataFrame([(1, "stock.mk.co.kr", None, "unknown", "news"), (2, "Maeil", "www.mk.co.kr", "daily", "news"), (3, "mk.co.kr", None, "unknown", "cafe"), (4, "Broker", None, "unknown", "news"), (5, "Other", None, "online", "news"), (6, "Broker Inc", None, "vendor", "vendor")], MEDIA)
    rules = spark.createDataFrame([(0, "major", "Maeil", ["mk.co.kr"], "news"), (1, "vendor", "Broker Inc", ["Broker"], "vendor"), (2, "wire", "Late", ["Maeil"], "news"), (3, "daily", "new.example.com", [], "news")], RULES)
    got = {r["media_id"]: tuple(r)[1:] for r in ledger.merge_media(media, rules).collect()}
    assert got[1] == (1, "Maeil", "major", "news") and got[2] == got[1]
    assert got[3] == (3, "mk.co.kr", "unknown", "cafe")  # another channel
    assert got[4] == (4, "Broker Inc", "vendor", "vendor") == got[6]  # drawn out of news, and the name's holder with it
    assert got[5] == (5, "Other", "online", "news")
    after = sorted(tuple(r) for r in ledger.merged_outlets(media, rules).collect())
    assert after[0] == (1, "Maeil", "mk.co.kr", "major", "news")
    assert after[-2:] == [(7, "Late", None, "wire", "news"), (8, "new.example.com", "new.example.com", "daily", "news")]
    assert [r[0] for r in after] == [1, 3, 4, 5, 7, 8]


def test_rules_of_one_name_end_as_the_last(spark):
    media = spark.createDataFrame([(1, "a", None, "unknown", "news"), (2, "b", None, "unknown", "news")], MEDIA)
    rules = spark.createDataFrame([(0, "daily", "X", ["a"], "news"), (1, "major", "X", ["b"], "news")], RULES)
    assert sorted(tuple(r) for r in ledger.merge_media(media, rules).collect()) == [(1, 2, "X", "major", "news"), (2, 2, "X", "major", "news")]


def test_press_is_recovered_by_number_then_domain(spark):
    from tidemark.schema import PLACEHOLDER

    media = spark.createDataFrame([(1, PLACEHOLDER, None, "unknown", "news"), (2, "Named", None, "unknown", "news"), (3, "Blog", None, "blog", "cafe")], MEDIA)
    urls = {10: (2, "http://n.co.kr/article/015/1"), 11: (1, "http://n.co.kr/article/015/2"), 12: (1, "http://www.ac.kr.x.co.kr/article/99/1"), 13: (1, None), 14: (3, "http://n/article/77/1"), 15: (1, "http://b.or.kr/article/77/1"), 16: (1, "http://y.ac.kr/article/015"), 17: (2, "http://z/article/016/")}
    docs = spark.createDataFrame([(k, m, u) for k, (m, u) in urls.items()], "doc_id long, media_id long, url string")
    assert sorted(tuple(r) for r in ledger.oid_index(docs, media).collect()) == [("015", "Named", "unknown"), ("016", "Named", "unknown")]
    got = {r["doc_id"]: (r["outlet"], r["tier"]) for r in ledger.recover_press(docs, media).collect()}
    assert got == {11: ("Named", "unknown"), 12: ("x.co.kr", "unknown"), 15: ("b.or.kr", "unknown"), 16: ("ac.kr", "unknown")}


def test_health_counts_dated_documents_and_leading_codes(spark):
    entities = spark.createDataFrame([("A", 1, 1), ("B", 3, 1), ("C", 1, 0)], "code string, priority int, is_active int")
    t = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([("A", D(2024, 1, 1), t), ("A", None, None), ("C", D(2024, 1, 1), t)], "code string, kst_date date, published_utc timestamp")
    sd = spark.createDataFrame([("A", 1), ("B", 2)], "code string, doc_cnt long")
    assert [tuple(r) for r in health.consistency(docs, sd, entities).collect()] == [("B", 0, 2)]
    cov = spark.createDataFrame([("A", D(2024, 1, 1)), ("B", D(2023, 1, 1))], "code string, kst_date date")
    assert [tuple(r) for r in health.stale(entities, cov, F.lit("2024-01-04").cast("date")).collect()] == [("A", 3, "WARN")]


def test_more_text_functions(spark):
    cases = {
        "x〔속보〕 Samsung-Samsung 12.34": "xsamsungsamsung12",
        "(종합2보) 가즈아 - 2222": "가즈아",
        "와아아아아 _1": "와아아",
    }
    for title, want in cases.items():
        assert one(spark, tx.normalize_title(F.lit(title))) == want, title
    assert one(spark, tx.normalize_title(F.lit("abc a"), ("a", "abc"))) == "bc"  # in the order given
    assert one(spark, tx.registrable(F.lit("stock.mk.co.kr."))) == "mk.co.kr"
    assert one(spark, tx.registrable(F.lit("mk.co.kr/a"))) is None and one(spark, tx.registrable(F.lit("plain"))) is None
    assert one(spark, tx.registrable_kr(F.lit("a.b.ac.kr"))) == "ac.kr" and one(spark, tx.registrable_kr(F.lit("www.b.pe.kr"))) == "b.pe.kr"
    assert one(spark, tx.article_id(F.lit("/article/015/1"))) == "015" and one(spark, tx.article_id(F.lit("/article/015"))) is None
    assert one(spark, tx.clean_html(F.lit('<a href="#p1">&gt;&gt;123</a>buy<br>now<b>!</b>&nbsp;&amp; hold'))) == "buy now ! & hold"
    assert one(spark, tx.element_text(F.lit(" <b> a </b> c &amp; d "))) == "ac & d"
    assert one(spark, tx.unmarked(F.lit(" <b>up</b>turn &lt;x&gt; "))) == "upturn <x>"
    ready = [one(spark, fin.readiness(F.lit(p), F.lit(n), F.lit(q))) for p, n, q in ((2000, 5, 70.0), (2000, 5, 69.9), (2000, 0, 0.0), (1999, 9, 99.0))]
    assert ready == ["ready", "labelling", "collecting", "preparing"]


def test_bodies_are_decoded_by_header_page_or_guess(spark):
    from tidemark.sources.parsers import decode_body

    korean = "주식 급등"
    rows = [
        (korean.encode("euc-kr"), "text/html; charset=EUC-KR", korean),
        (b'<meta charset="euc-kr">' + korean.encode("euc-kr"), "text/html", '<meta charset="euc-kr">' + korean),
        (b" " * 4000 + b"charset=euc-kr " + korean.encode("euc-kr"), None, " " * 4000 + "charset=euc-kr " + korean),
        (korean.encode("cp949"), "", korean),
        (korean.encode(), None, korean),
        (b"\xe9t\xe9", "x; charset=iso-8859-1", "été"),
        (b"a\xff", "x; charset=nonsense", "a�"),
        (None, None, None),
    ]
    x = spark.createDataFrame([(bytearray(b) if b is not None else None, h, w) for b, h, w in rows], "body binary, header string, want string")
    assert all(r["got"] == r["want"] for r in x.select("want", decode_body("body", "header").alias("got")).collect())


def test_board_rows_with_few_cells_and_titles(spark):
    from tidemark.sources.parsers import parse_board

    html = "<table><tr><td>2024.01.02 03:04</td><td class='title'><a href='/read?code=1&nid=7&page=1' title=' Whole title '>Whole...</a></td><td> who <b>x</b></td></tr><tr><td>2024.01.02 03:05</td><td><a href='?nid=8'>Short</a></td><td></td><td>1,234</td><td>-</td></tr><tr><td>bad</td><td><a href='?nid=9'>no</a></td><td>z</td></tr></table>"
    got = [tuple(r) for r in parse_board(spark.createDataFrame([(html,)], "html string")).orderBy("nid").collect()]
    assert [g[:1] + g[2:] for g in got] == [(7, "Whole title", "whox", None, None, None), (8, "Short", None, 1234, None, None)]


def test_an_address_is_known_on_any_day_of_a_stream(spark, tmp_path):
    from tidemark.streaming import ingest

    cols = "doc_id long, code string, media_id long, source string, url string, title string, published_utc timestamp, kst_date date, label int, is_relevant int, is_canonical int"
    row = lambda k, url, day: (k, "A", 1, "s", url, "t", dt.datetime(2024, 1, day), D(2024, 1, day) if day else None, 1, 1, 1)
    days = [[row(1, "u1", 1), row(2, None, 1), row(3, "u2", 1)], [row(4, "u1", 2), row(5, "u3", 2), row(6, None, 2), row(7, "u3", 2)]]
    days[1].append((8, "A", 1, "s", "u9", "t", None, None, 1, 1, 1))
    p = {k: str(tmp_path / k) for k in ("in", "docs", "daily", "undated")}
    for n, rows in enumerate(days):
        x = spark.createDataFrame(rows, cols)
        x.write.mode("append").parquet(p["in"])
        for again in range(2):  # the second run of a batch starts from a lost checkpoint and changes nothing
            stream = ingest.read_documents(spark, p["in"], x.schema)
            ingest.ingest(stream, p["docs"], p["daily"], str(tmp_path / f"check{n}{again}"), p["undated"]).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(p["docs"]).collect()) == [1, 2, 3, 5, 6]
    assert sum(r["doc_cnt"] for r in spark.read.parquet(p["daily"]).collect()) == 5
    assert {r["doc_id"] for r in spark.read.parquet(p["undated"]).collect()} == {8}


def test_distilled_scores(spark):
    rows = [("A", D(2024, 1, 1), t, g) for t, g in (("P", "P"), ("P", "N"), ("N", "N"), ("X", "X"), ("N0", "N0"))]
    got = experiments.macro_f1(spark.createDataFrame(rows, "code string, kst_date date, truth string, guess string")).first()
    # P and N: 2 * 1 / 3; the others 1
    assert (got["n"], got["accuracy"], got["macro_f1"]) == (5, 0.8, pytest.approx((2 / 3 + 2 / 3 + 2) / 4))
    grams = one(spark, experiments.word_grams(F.lit("ab c")))
    assert sorted(grams) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
