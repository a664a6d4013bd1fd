from __future__ import annotations

from collections import defaultdict
from math import exp, log

from pyspark.sql import functions as F

from tallyscope.llm import quality


def held_out_accuracy(spark, documents, labels, sites) -> float:
    train = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    found = quality.classify(documents, labels.filter(train), sites=sites)
    judged = found.join(labels.filter(~train), "doc_id").filter("quality IS NOT NULL")
    return judged.agg(F.avg(F.when(F.col("kept") == (F.col("quality") == 1), 1.0).otherwise(0.0))).first()[0]


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    assert held_out_accuracy(spark, documents, labels, ("source", "lang")) > 0.95


def test_sparse_sites_shrink_towards_their_parent(spark):
    # 40 documents of one good host, a path with one bad-looking document below it.
    good, bad = "plain words follow one another here today " * 12, "### $$$ %%% ### " * 40
    rows = [(i, good + str(i), "h", "a", 1) for i in range(40)] + [(40, bad, "h", "b", 0)]
    rows += [(100 + i, bad + str(i), "g", "a", 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    found = {r["doc_id"]: r for r in quality.classify(frame, frame.select("doc_id", "quality")).collect()}
    assert found[0]["kept"] and not found[100]["kept"]
    assert found[0]["p_host"] > 0.8 > 0.2 > found[100]["p_host"]
    # The only document of its path leaves the path with its parent's rate.
    assert abs(found[40]["p_path"] - found[40]["p_host"]) < 1e-9


def test_prior_weight_reads_variance_between_groups(spark):
    same = spark.createDataFrame([(100, 50.0), (100, 52.0), (100, 49.0)], "n long, good double")
    apart = spark.createDataFrame([(100, 95.0), (100, 5.0), (100, 50.0)], "n long, good double")
    assert quality.prior_weight(same, F.lit(0.5)) > 1000 > 10 > quality.prior_weight(apart, F.lit(0.5))


def test_odd_rows(nasty, empty, labels):
    found = quality.classify(nasty, labels).collect()
    assert len(found) == nasty.count() and all(0 <= r["score"] <= 1 for r in found)
    kept = quality.drop_rejected(nasty, labels)
    assert kept.columns == nasty.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {7, 19} <= ids and not {17, 18} & ids
    assert quality.classify(empty, labels).collect() == []


def test_without_labels_all_stay(nasty, labels):
    assert quality.drop_rejected(nasty, labels.limit(0)).count() == nasty.count()


def by_hand(rows: list[tuple]) -> dict:
    """Posterior means and scores from (doc_id, site levels, p): plain loops over all documents."""
    clip = lambda p: min(0.99, max(0.01, p))
    odds = lambda p: log(p / (1 - p))
    overall = clip(sum(p for _, _, p in rows) / len(rows))
    depth = len(rows[0][1])
    groups = [defaultdict(list) for _ in range(depth)]
    for doc, site, p in rows:
        for i in range(depth):
            groups[i][site[: i + 1]].append((doc, p))
    weights, rate = [], {(): overall}
    for i in range(depth):
        spread = chance = total = n_all = 0.0
        for site, own in groups[i].items():
            n, mean = len(own), rate[site[:-1]]
            seen = sum(p for _, p in own) / n
            spread, chance = spread + n * (seen - mean) ** 2, chance + mean * (1 - mean)
            total, n_all = total + n * mean * (1 - mean), n_all + n
        between = max(spread - chance, 0.0) / n_all
        weights.append(max(1.0, min(1e6, total / n_all / between - 1 if between > 0 else 1e6)))
        for site, own in groups[i].items():
            rate[site] = (sum(p for _, p in own) + weights[i] * rate[site[:-1]]) / (len(own) + weights[i])
    out = {}
    for doc, site, p in rows:
        at, rates = overall, []
        for i in range(depth):
            others = [q for d, q in groups[i][site[: i + 1]] if d != doc]
            at = (sum(others) + weights[i] * at) / (len(others) + weights[i])
            rates.append(at)
        out[doc] = (rates[0], rates[-1], 1 / (1 + exp(-(odds(p) + odds(clip(rates[-1])) - odds(overall)))))
    return out


def test_posteriors_against_plain_loops(spark):
    base = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in quality.classify(documents, labels).collect()}
    sites = {r["doc_id"]: (r["source"], r["lang"]) for r in documents.collect()}
    want = by_hand([(d, sites[d], r["p_document"]) for d, r in found.items()])
    assert len(found) == len(sites) >= 200
    for doc, r in found.items():
        assert all(abs(a - b) < 1e-9 for a, b in zip(want[doc], (r["p_host"], r["p_path"], r["score"]), strict=True)), doc
        assert r["kept"] == (r["score"] >= 0.5)
