"""Queries over a persistent index of the embeddings; a third of them is appended after it is built."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index, vectors
from ..operators.scratch import new_path
from .catalogue import _UNIT, _tiles, query

_EXACT = _UNIT + """, s AS (SELECT q.id, r.id AS ref, round(list_dot_product(q.u, r.u), 12) AS sim FROM u q, u r WHERE q.id <> r.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, ref) AS rank FROM s)"""


def _indexed(spark, sf_dir):
    tiles, path = _tiles(spark, sf_dir), new_path(spark, "index")
    later = F.col("id") % 3 == 1
    index.build(tiles.filter(~later), path, extractor="table")
    index.append(tiles.filter(later), path, extractor="table")
    return tiles, path


@query(_EXACT + " SELECT id, ref, round(sim, 6) AS sim, rank::INTEGER AS rank FROM k WHERE rank <= 7")
def index_all_lists(spark, sf_dir):
    """A search through all lists of the index: exact."""
    tiles, path = _indexed(spark, sf_dir)
    found = index.search(tiles, path, vectors.TOP_K, index.MOST_LISTS, extractor="table", skip_self=True)
    return found.select("id", "ref", F.round("sim", 6).alias("sim"), "rank")


@query("SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE embedding IS NOT NULL")
def index_recall(spark, sf_dir):
    """Whether two thirds of the lists hold at least nine tenths of each query's seven nearest, over all queries."""
    tiles, path = _indexed(spark, sf_dir)
    exact = index.search(tiles, path, vectors.TOP_K, index.MOST_LISTS, skip_self=True).select("id", "ref")
    near = index.search(tiles, path, vectors.TOP_K, skip_self=True).select("id", "ref", F.lit(1).alias("hit"))
    both = exact.join(near, ["id", "ref"], "left")
    return both.agg(F.countDistinct("id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))
