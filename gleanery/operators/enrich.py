"""Model answers to typed columns, and calls of a model function on distinct jobs."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_CAP, EVIDENCE_CAP, ERROR_CAP, LEAST_TEXT = 12, 8, 500, 50
SCHEMA = (
    "ai_key string, quality_score int, summary_alignment_score int, extraction_completeness_score int, article_relevance_score int, source_reliability_score int, "
    "national_outlet_confidence int, outlet_country_confidence int, ai_verification_status string, headline string, author string, is_national_outlet boolean, outlet_country string, "
    "executive_summary string, summary_alignment_notes string, key_entities array<string>, key_quotes array<string>, evidence array<struct<claim:string,quote:string,relevance:string>>, evidence_count int, tone_and_bias string"
)


def list_column(c: Column) -> Column:
    """A text's parts between commas or bars, trimmed, the first LIST_CAP that aren't empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,|]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(parts, 1, LIST_CAP)


def evidence_column(c: Column) -> Column:
    """JSON text to claims: other names are understood, items without claim and quote dropped, EVIDENCE_CAP kept; null without a JSON array."""
    names = ["claim", "point", "label", "quote", "evidence", "text", "relevance", "reason", "note"]
    items = F.from_json(c, "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")
    pick = lambda x, *ns: F.trim(F.coalesce(*(x[n] for n in ns), F.lit("")))
    made = F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.struct(pick(x, "claim", "point", "label").alias("claim"), pick(x, "quote", "evidence", "text").alias("quote"), pick(x, "relevance", "reason", "note").alias("relevance")))
    return F.slice(F.filter(made, lambda x: (x["claim"] != "") | (x["quote"] != "")), 1, EVIDENCE_CAP)


def js_number(v: Any) -> float:
    if v is None or v is False or v == "" or isinstance(v, str) and not v.strip():
        return 0.0
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str):
        s = v.strip()
        try:
            return float(int(s, 0)) if re.match(r"0[xXbBoO]", s) else float(s) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s) else math.nan
        except ValueError:
            return math.nan
    return math.nan


def clamp(v: Any, default: int, given: bool = True) -> int:
    x = js_number(v) if given else math.nan
    return max(0, min(100, math.floor(x + 0.5))) if math.isfinite(x) else default


def _text(v: Any) -> str:
    return "" if v is None else (v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)).strip()


def answer_object(raw: str) -> dict:
    """The JSON object in a model's answer, inside a fence or among other words; ValueError if there is none."""
    t = re.sub(r"```\s*\Z", "", re.sub(r"\A```(?:json)?", "", raw.strip(), flags=re.I)).strip()
    try:
        v = json.loads(t)
        if isinstance(v, dict):
            return v
    except ValueError:
        pass
    m = re.search(r"\{.*\}", t, re.S)
    if not m:
        raise ValueError("the answer holds no JSON object")
    return json.loads(m[0])


def normalised(o: dict) -> dict:
    """An answer under its several names as one record of SCHEMA without the key."""
    get = lambda *names: next((o[n] for n in names if o.get(n) is not None), None)
    points = lambda default, *names: clamp(get(*names), default, any(n in o for n in names))
    as_list = lambda v: ([x for x in map(_text, v) if x] if isinstance(v, list) else [x.strip() for x in re.split(r"[,|]", v) if x.strip()] if isinstance(v, str) else [])[:LIST_CAP]
    items = get("evidence", "supporting_evidence", "evidence_quotes")
    evidence = []
    for x in items if isinstance(items, list) else []:
        if isinstance(x, dict):
            one = lambda *names, x=x: _text(next((x[n] for n in names if x.get(n) is not None), None))
            e = {"claim": one("claim", "point", "label"), "quote": one("quote", "evidence", "text"), "relevance": one("relevance", "reason", "note")}
            if e["claim"] or e["quote"]:
                evidence.append(e)
    evidence = evidence[:EVIDENCE_CAP]
    national, place = bool(o.get("is_national_outlet")), _text(o.get("outlet_country"))
    return {
        "quality_score": points(50, "quality_score"), "summary_alignment_score": points(0, "summary_alignment_score"),
        "extraction_completeness_score": points(0, "extraction_completeness_score", "completeness_score"), "article_relevance_score": points(0, "article_relevance_score", "relevance_score"),
        "source_reliability_score": points(0, "source_reliability_score", "source_score"), "national_outlet_confidence": points(75 if national else 0, "national_outlet_confidence"),
        "outlet_country_confidence": points(70 if place else 0, "outlet_country_confidence"), "ai_verification_status": (_text(get("ai_verification_status", "status", "verification_status")) or "UNKNOWN").upper(),
        "headline": _text(o.get("headline")), "author": _text(o.get("author")), "is_national_outlet": national, "outlet_country": place or "Unknown",
        "executive_summary": _text(get("executive_summary", "deep_summary", "summary")), "summary_alignment_notes": _text(get("summary_alignment_notes", "reasoning", "alignment_reasoning")),
        "key_entities": as_list(o.get("key_entities")), "key_quotes": as_list(o.get("key_quotes")), "evidence": evidence, "evidence_count": len(evidence), "tone_and_bias": _text(o.get("tone_and_bias")),
    }


def failed(status: str, note: str) -> dict:
    zero = {f.split()[0]: 0 for f in SCHEMA.split(", ") if f.endswith(" int")}
    return normalised({}) | zero | {"ai_verification_status": status, "summary_alignment_notes": note[:ERROR_CAP], "outlet_country": "Unknown"}


def analysed(jobs: DataFrame, model: Callable[[str], str] | None) -> DataFrame:
    """jobs (ai_key, pack) to SCHEMA: one call each, on the executors. Errors become rows with status API_ERROR."""
    names = [f.split()[0] for f in SCHEMA.split(", ") if " " in f][:]

    def one(pack: str | None) -> dict:
        if model is None:
            return failed("AI_DISABLED", "no model was given")
        if len((pack or "").strip()) < LEAST_TEXT:
            return failed("REJECTED_EMPTY_TEXT", "there is too little text")
        try:
            return normalised(answer_object(model(pack)))
        except Exception as e:  # a model may fail in any way; that is a result, not a failed task
            return failed("API_ERROR", str(e))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([{"ai_key": k} | one(p) for k, p in zip(f.ai_key, f["pack"])], columns=names)

    return jobs.select("ai_key", "pack").mapInPandas(run, SCHEMA)
