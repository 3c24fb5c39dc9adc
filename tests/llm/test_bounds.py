"""Bounds that the docstrings state: rows a model is fitted on, rows of one identifier in a task, templates that decide, columns of any kind."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import html_extract, labelled, token_store, topk

POOL = ["About us", "Jobs", "Contact", "Press room", "Terms of use", "Help", "Imprint", "Partners", "Shop", "Archive"]


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(5000)] + [(i, f"own {i}") for i in range(100, 160)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1), (7, 0)] + [(i, i % 2) for i in range(100, 160)], "doc_id long, toxic int")
    rows = labelled.training_rows(docs, labels, "toxic", 10).collect()
    assert len(rows) == 10 == len({r["doc_id"] for r in rows})
    every = {r["doc_id"]: r for r in labelled.training_rows(docs, labels, "toxic").collect()}
    held = {r[0] for r in docs.where(labelled.held_out()).select("doc_id").distinct().collect()}
    assert 7 in held or every[7]["y"] == 1
    assert set(every) == {7, *range(100, 160)} - held
    again = {r["doc_id"]: r["text"] for r in labelled.training_rows(docs.repartition(3), labels, "toxic").collect()}
    assert again == {i: r["text"] for i, r in every.items()}
    nulls = spark.createDataFrame([(100, None), (100, ""), (None, "x")], "doc_id long, text string")
    assert all((r["text"] or "") == "" for r in labelled.training_rows(nulls, labels, "toxic").collect())
    assert labelled.training_rows(docs.limit(0), labels, "toxic").count() == 0


@pytest.mark.parametrize("column", ["map", "variant", "dotted", "binary"])
def test_pipeline_carries_columns_of_any_kind(spark, tmp_path, column):
    import corpus_pipeline

    made = {"map": "map('k', id)", "variant": "parse_json(concat('{\"a\":', id, '}'))", "dotted": "id", "binary": "cast(cast(id as string) as binary)"}[column]
    name = "a.b" if column == "dotted" else "rank"
    docs = spark.range(12).select((F.col("id") % 5).alias("doc_id"), F.concat(F.lit("some words that differ "), (F.col("id") % 7).cast("string")).alias("text"), F.expr(made).alias(name))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = "to_json(struct(*))"
    before = Counter(r[0] for r in docs.selectExpr(text).collect())
    for stage, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, stage
        after = Counter(r[0] for r in out.selectExpr(text).collect())
        assert after and not after - before, stage
        out.write.parquet(f"{tmp_path}/{stage}")
        assert spark.read.parquet(f"{tmp_path}/{stage}").columns == docs.columns
    assert corpus_pipeline.drop_exact_copies(spark, docs, "").count() == 7  # a row each text
    assert corpus_pipeline.pack(spark, docs, "").where("piece = 0").count() == 12


def test_store_spreads_rows_of_one_identifier(spark, tmp_path):
    rows = [(None, "the same words again and again")] * 400 + [(None, f"own words {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    token_store.write_store(docs, f"{tmp_path}/s")
    file = F.input_file_name()
    parts = spark.read.parquet(f"{tmp_path}/s/parts").where("kind = 'doc'").groupBy(file).count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 400
    equal = spark.read.parquet(f"{tmp_path}/s/recipes").groupBy("chunks", file).count().where("count > 20").collect()
    assert len(equal) > 1  # equal rows are cut by the ranges too
    back = token_store.store_documents(docs).collect()
    assert len(back) == 800 and len({r["start"] for r in back}) == 800 and max(r["start"] + r["n_tokens"] for r in back) == sum(r["n_tokens"] for r in back)


def test_shards_spread_rows_of_one_identifier(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 50)
    seen = []
    monkeypatch.setattr(topk, "written", lambda df, name, *a, real=topk.written: seen.append((name, out := real(df, name, *a))) or out)
    rng = random.Random(4)
    rows = [(3, [rng.random() for _ in range(4)]) for _ in range(200)] + [(3, [1.0] * 4)] * 200 + [(i, [rng.random() for _ in range(4)]) for i in range(20, 60)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    trees = next(df for name, df in seen if name == "trees")
    assert trees.count() == -(-440 // 50) and max(len(r["ids"]) // 8 for r in trees.collect()) < 100
    assert {r["query_id"] for r in got} == {20, 40} and {r["rank"] for r in got} == set(range(1, 21)) and max(Counter(r["query_id"] for r in got).values()) == 20


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.1/pages.parquet")


def test_html_templates_alone_remove_the_frames(spark, pages):
    """With every rule on tags and class names off, recurrence takes what stands outside articles and nothing inside."""
    r = html_extract.template_effect(pages).first()
    assert r["outside_left"] < 0.1 * r["outside"] and r["inside_left"] > 0.99 * r["inside"]
    none = html_extract.template_effect(pages, html_extract.site_templates(pages).limit(0)).first()
    assert none["outside_left"] == none["outside"] == r["outside"]


def _page(i, rng, content, menu="menu", article=True):
    words = rng.sample(POOL, 3)
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words)
    box = f"<div class='x{menu}'><ul>{links}</ul></div><div class='zz'>{rng.choice(POOL)} {rng.randint(1, 9)} offers</div>"
    tag = "article" if article else "div class='body'"
    return f"<html><head><title>T{i}</title></head><body>{box}<{tag}>{content}</{tag.split()[0]}></body></html>"


def test_html_slots_are_found_without_rules_or_articles(spark):
    rng = random.Random(2)
    own = lambda i: f"<p>{' '.join(f'w{rng.randrange(10**6)}' for _ in range(40))} number {i}</p>"
    rows = [(i, "https://a.example/x", own(i)) for i in range(60)]
    made = [(i, u, _page(i, rng, c, article=i % 3 > 0)) for i, u, c in rows]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(made, "page_id long, url string, html string").repartition(4)).collect()}
    want = {i: c[3:-4] for i, _, c in rows}
    assert {i: got[i] for i in want if i % 3} == {i: want[i] for i in want if i % 3}
    assert all(want[i] in got[i] for i in want)  # pages without an article keep their text


def test_html_copied_content_is_no_slot(spark):
    """Copies under changing frames, on pages without an article: the text stays."""
    rng = random.Random(3)
    text = "<p>" + "copied words " * 30 + "</p>"
    made = [(i, "https://b.example/", _page(i, rng, text if i % 4 == 0 else f"<p>{' '.join(f'v{rng.randrange(10**6)}' for _ in range(40))}</p>", article=False)) for i in range(60)]
    got = html_extract.extract_pages(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert all(("copied words" in r["text"]) == (r["page_id"] % 4 == 0) and len(r["text"]) > 150 for r in got)
