"""JSON documents as columns: prediction rows, flattened payloads, region collections, and what is hidden from a consumer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import json_object

# The output contract, evidence fields that a consumer doesn't see, and path fields.
REPLY = "roi_assessment array<variant>, thoughts string, diagnosis string, npm1_prediction struct<applicable:string,classification:string,justification:string>"
EVIDENCE = ["bad_likelihood", "bad_margin", "bad_top1_similarity", "good_top1_similarity", "blast_top1_similarity", "blast_similarity_score", "retrieved_bad_refs", "retrieved_good_refs", "retrieved_blast_refs", "reference_mode", "aml_reference_evidence"]
PATHS = ["debug_path", "path", "auto_saved_tile_path", "out_dir", "save_dir", "output_path", "overlay_path", "candidate_overlay_path", "overview_path"]


def without_evidence(rows: DataFrame) -> DataFrame:
    """rows without the columns that hold reference evidence."""
    return rows.drop(*EVIDENCE)


_TOKEN = re.compile(r'\s+|"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+|"')


def stripped(document: str, names: frozenset[str]) -> str:
    """The document without the members of these names, whatever their values and at any depth; all else stays as it is written.

    One pass over the tokens: a member goes from its name to the end of its value, with the comma before it, or the one after it if it comes first.
    """
    tokens = _TOKEN.findall(document)
    out: list[str] = []
    inside: list[list] = []  # of each open bracket: which one, whether a member stands already, and where what follows the last comma begins
    i, n = 0, len(tokens)
    while i < n:
        token = tokens[i]
        if token in "{[":
            inside.append([token, False, len(out) + 1])
        elif token in "}]" and inside:
            inside.pop()
        elif token == "," and inside and inside[-1][0] == "{":
            inside[-1][2] = len(out)
        elif token[0] == '"' and inside and inside[-1][0] == "{" and not any(t[0] not in ", \n\t\r" for t in out[inside[-1][2] :]):
            after = next((k for k in range(i + 1, n) if not tokens[k].isspace()), n)
            if after < n and tokens[after] == ":" and token[1:-1] in names:
                i, depth = after + 1, 0
                while i < n and (depth or tokens[i] not in ",}]"):
                    depth += (tokens[i] in "{[") - (tokens[i] in "}]")
                    i += 1
                del out[inside[-1][2] :]
                if not inside[-1][1] and i < n and tokens[i] == ",":
                    i += 1  # the next member is the first one now
                    while i < n and tokens[i].isspace():
                        i += 1
                    inside[-1][2] = len(out)
                continue
            inside[-1][1] = True
        out.append(token)
        i += 1
    return "".join(out)


@F.pandas_udf(T.StringType())
def without_paths(document: pd.Series) -> pd.Series:
    """JSON texts without the members that name a server's files, at any depth and with any value; null stays null."""
    names = frozenset(PATHS)
    return document.map(lambda d: stripped(d, names) if d is not None else None)


def _field(document: Column, path: str) -> Column:
    return F.get_json_object(document, f"$.{path}")


def prediction_row(rows: DataFrame, reply: str = "final_output", decision: str = "final_decision", keep: list[str] | None = None) -> DataFrame:
    """keep, then the fields of each reply as columns: diagnosis (else the decision), thoughts, the nested prediction and the assessment.

    A reply that is no JSON object gives empty fields; fields of a reply that lack are empty.
    """
    body = F.coalesce(json_object(F.col(reply)), F.lit("{}"))
    empty = F.lit("")
    inner = _field(body, "npm1_prediction")
    is_object = F.startswith(F.coalesce(inner, empty), F.lit("{"))
    part = lambda n: F.when(is_object, F.coalesce(_field(body, f"npm1_prediction.{n}"), empty)).otherwise(empty)
    return rows.select(
        *(keep or []),
        F.coalesce(_field(body, "diagnosis"), F.col(decision)).alias("diagnosis"), F.col(decision).alias("final_decision"), F.coalesce(_field(body, "thoughts"), empty).alias("thoughts"),
        F.when(is_object, inner).otherwise(empty).alias("npm1_prediction"), part("applicable").alias("npm1_applicable"), part("classification").alias("npm1_classification"), part("justification").alias("npm1_justification"),
        F.coalesce(_field(body, "roi_assessment"), empty).alias("roi_assessment"),
    )


def meets_contract(reply: Column) -> Column:
    """Whether a JSON text has a diagnosis, thoughts, a list of assessments and a nested prediction."""
    parsed = F.from_json(reply, "roi_assessment string, thoughts string, diagnosis string, npm1_prediction string")
    listed = F.startswith(F.coalesce(parsed["roi_assessment"], F.lit("")), F.lit("["))
    nested = F.startswith(F.coalesce(parsed["npm1_prediction"], F.lit("")), F.lit("{"))
    return F.coalesce(parsed["thoughts"].isNotNull() & parsed["diagnosis"].isNotNull() & listed & nested, F.lit(False))


def flattened(rows: DataFrame, payload: str, keep: list[str], lists: str = "roi_assessment") -> DataFrame:
    """(keep, item, fields): a row for each entry of a payload, with its members as a map of texts.

    A list gives a row for each of its objects; an object with a list of assessments a row for each of those, with the
    object's own members beside theirs (theirs win); any other object one row; what is no JSON one row without fields.
    Nested values stay JSON texts.
    """
    text = F.trim(F.coalesce(F.col(payload), F.lit("")))
    kind = "map<string,string>"
    none = F.create_map().cast(kind)
    own = F.coalesce(F.from_json(F.when(F.startswith(text, F.lit("{")), text), kind), none)
    listed = F.when(F.startswith(text, F.lit("[")), text).otherwise(own[lists])
    items = F.from_json(F.when(F.startswith(F.trim(F.coalesce(listed, F.lit(""))), F.lit("[")), listed), f"array<{kind}>")
    base = F.map_filter(own, lambda k, _: k != lists)
    merged = F.transform(items, lambda m: F.map_from_entries(F.concat(F.map_entries(F.map_filter(base, lambda k, _: ~F.map_contains_key(F.coalesce(m, none), k))), F.map_entries(F.coalesce(m, none)))))
    return rows.select(*keep, F.posexplode(F.when(F.size(merged) > 0, merged).otherwise(F.array(own))).alias("item", "fields"))


def columns_of(flat: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """Chosen fields of flattened rows as columns, absent ones empty (the names are the sheet's header)."""
    return flat.select(*keep, "item", *[F.coalesce(F.col("fields")[n], F.lit("")).alias(n) for n in names])


def field_names(flat: DataFrame) -> DataFrame:
    """(name, n): the members that occur and in how many rows, for a header."""
    return flat.select(F.explode(F.map_keys("fields")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def manifest_summary(manifest: Column) -> Column:
    """(slide_name, accepted): the slide and the number of accepted regions of a manifest; null if it is empty or no JSON."""
    parsed = F.from_json(manifest, "slide_name string, accepted_rois array<string>")
    rois = parsed["accepted_rois"]
    return F.when(F.size(F.coalesce(rois, F.array().cast("array<string>"))) > 0, F.struct(parsed["slide_name"].alias("slide_name"), F.size(rois).alias("accepted")))


def report(rows: DataFrame, by: list[str], title: str, body: str, importance: str, key: str) -> DataFrame:
    """(by, report): a text with a heading and a line for each region, the most important first, then by key."""
    line = F.concat(F.lit("- "), F.col(title), F.lit(": "), F.coalesce(F.col(body).cast("string"), F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col(importance)).alias("o"), F.col(key).alias("k"), line.alias("t"))))  # regions of one report
    s = rows.groupBy(*by).agg(listed.alias("_l"))
    return s.select(*by, F.array_join(F.concat(F.array(F.concat(F.lit("# "), *[F.col(c).cast("string") for c in by])), F.transform("_l", lambda x: x["t"])), "\n").alias("report"))
