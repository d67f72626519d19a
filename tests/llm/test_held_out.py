"""What the trained models do on rows that they have not learned from."""

import os

import numpy as np
import pytest

from hearthbook.llm import queries

FOLDER = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def test_toxicity_on_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.op8_nnpu_toxicity(spark, FOLDER).where("held_out").collect() if labels.get(r.doc_id) is not None]
    score, predicted, toxic = map(np.array, zip(*rows, strict=True))
    rank = np.argsort(np.argsort(score)) + 1
    area = (rank[toxic == 1].sum() - (toxic == 1).sum() * ((toxic == 1).sum() + 1) / 2) / ((toxic == 1).sum() * (toxic == 0).sum())
    assert len(rows) > 900 and area > 0.95
    assert (toxic[predicted == 1] == 1).mean() > 0.93 and (predicted[toxic == 1] == 1).mean() > 0.78


def test_language_on_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op9_ecoc_language_id(spark, FOLDER).where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 1800 and np.mean([langs[r.doc_id] == r.lang_pred for r in rows]) > 0.99
