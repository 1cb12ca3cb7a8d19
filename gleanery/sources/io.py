"""Sources and sinks: manifests, page providers, the result cache, exports and small side tables."""

from __future__ import annotations

import json

import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gleanery.functions.constants import SUMMARY_NAMES, TITLE_NAMES, URL_NAMES
from gleanery.functions.text import clip, compact, strip


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; all columns text, names and values trimmed, blank rows dropped, broken rows an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    names = [c.strip() for c in raw.columns]
    return drop_blank(raw.toDF(*names).select(*(strip(F.col(f"`{c}`")).alias(c) for c in names)))


def drop_blank(rows: DataFrame) -> DataFrame:
    """Rows in which any value isn't blank."""
    return rows.where(F.exists(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)), lambda x: strip(x) != ""))


def read_rows_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON rows, one per line or in one array, gzipped or not; the union of all their columns."""
    return spark.read.option("multiLine", not path.endswith(("jsonl", "jsonl.gz"))).json(path)


def payload(body: bytes, content_type: str = "application/json", encoding: str = "identity") -> dict:
    """A request's JSON object; ValueError says what is wrong with it."""
    import gzip

    if "application/json" not in content_type.lower():
        raise ValueError("the body must be application/json")
    if encoding not in ("identity", "gzip", ""):
        raise ValueError(f"encoding {encoding} isn't supported")
    text = (gzip.decompress(body) if encoding == "gzip" else body).decode()
    if not text.strip():
        raise ValueError("the body is empty")
    try:
        value = json.loads(text)
    except ValueError:
        raise ValueError("the body is no JSON") from None
    if not isinstance(value, dict) or not (value.get("csvText") or value.get("rows")):
        raise ValueError("csvText or rows must be given")
    rows = value.get("rows") or []
    if not isinstance(rows, list) or not all(isinstance(r, dict) and not any(isinstance(x, (dict, list)) for x in r.values()) for r in rows):
        raise ValueError("rows must be a list of flat objects")
    return value


def union_rows(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts with all their columns, in the order in which they first come up; absent ones are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def detect(columns: list[str], kind: str) -> str | None:
    """The url, title or summary column: by exact name in order of preference, then by likeness. Without one the first column is the url."""
    exact = {"url": URL_NAMES, "title": TITLE_NAMES, "summary": SUMMARY_NAMES}[kind]
    like = {"url": r"url|link|source|website|href", "title": r"title|headline|article name|\bhed\b", "summary": r"summary|snippet|abstract|description|teaser|dek"}[kind]
    low = {c.lower().strip(): c for c in reversed(columns)}
    for name in exact:
        if name in low:
            return low[name]
    return next((c for c in columns if re.search(like, c, re.I)), columns[0] if kind == "url" and columns else None)


def require(rows: DataFrame, url: str) -> DataFrame:
    if url not in rows.columns:
        raise ValueError(f"there is no column {url}")
    if rows.isEmpty():
        raise ValueError("there are no rows")
    return rows


def reader_pages(pages: DataFrame) -> DataFrame:
    """(job_key, url, body, http_status) of a reader proxy to text candidates: content is unwrapped from JSON answers."""
    inner = F.coalesce(F.get_json_object("body", "$.data.content"), F.get_json_object("body", "$.content"), F.col("body"))
    return pages.withColumn("text", F.when(F.col("body").rlike(r"^\s*\{"), inner).otherwise(F.col("body")))


def robots_allows(text: str | None, path: str, agent: str) -> bool:
    """The longest matching rule of the agent's group decides, or of group *; allow wins ties; no rules allow."""
    groups: list[tuple[set[str], list[tuple[bool, str]]]] = []
    open_group = False
    for line in (text or "").splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_group:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            open_group = True
        elif key in ("allow", "disallow") and groups:
            open_group = False
            if value:
                groups[-1][1].append((key == "allow", value))
    name = agent.lower()
    mine = [r for names, rules in groups if any(n != "*" and n in name for n in names) for r in rules]
    if not any(n != "*" and n in name for names, _ in groups for n in names):
        mine = [r for names, rules in groups if "*" in names for r in rules]
    best = (-1, True)
    for allow, rule in mine:
        pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.rstrip("$")) + (r"\Z" if rule.endswith("$") else "")
        if re.match(pattern, path):
            best = max(best, (len(rule), allow))
    return best[1]


def robots_gate(jobs: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """jobs (job_key, url, host) with robots_allowed and robots_note; robots has a row per host and is joined by it."""

    @F.pandas_udf(BooleanType())
    def allowed(text: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([robots_allows(t, p or "/", agent) for t, p in zip(text, path)])

    path = F.regexp_replace("url", r"^https?://[^/?#]*", "")
    out = jobs.join(robots.select("host", "robots_txt", F.col("http_status").alias("robots_status")), "host", "left")
    ok = F.when(F.col("robots_status") == 200, allowed("robots_txt", F.when(path == "", "/").otherwise(path))).otherwise(True)
    note = F.when(F.col("robots_status").isNull(), "robots.txt check failed").when(F.col("robots_status") != 200, "robots.txt unavailable").when(F.col("robots_allowed"), "robots.txt allowed").otherwise("blocked by robots.txt")
    return out.withColumn("robots_allowed", ok).withColumn("robots_note", note).drop("robots_txt", "robots_status")


def cache_key(url: Column, *parts: object) -> Column:
    return F.concat_ws("|", url, *(F.lit(str(p)) for p in parts))


def cached(jobs: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits with their result, jobs still to do) by cache_key; expired entries don't count, of several the latest does, of equally late ones the greatest."""
    live = cache.where(F.col("expires_at") > now).groupBy("cache_key").agg(F.max_by("result", F.struct("expires_at", "result")).alias("result"))
    return jobs.join(live, "cache_key").withColumn("from_cache", F.lit(True)), jobs.join(live, "cache_key", "left_anti")


def snapshots_url(timestamp: Column, original: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), timestamp, F.lit("id_/"), original)


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """Quotes only where needed; arrays and structs as JSON. one_file gathers a small export in one task."""
    flat = rows.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes))
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_docx(rows: DataFrame, path: str, table_rows: int = 500, articles: int = 250) -> None:
    """A briefing for readers: a table of the first rows and the first articles, clipped; the counts are the document's form."""
    names = [c for c in ("extracted_headline", "extracted_site_name", "quality_label", "quality_score", "source_url_used") if c in rows.columns]
    top = rows.orderBy("row_id").limit(table_rows).select(*(compact(F.col(c).cast("string"), 80 if c != "source_url_used" else 140).alias(c) for c in names)).collect()
    body = [c for c in ("executive_summary", "fetched_text") if c in rows.columns]
    texts = rows.orderBy("row_id").limit(articles).select(F.col(names[0]).alias("h"), *(F.substring(F.coalesce(c, F.lit("")), 1, 1200 if c == "executive_summary" else 3500).alias(c) for c in body)).collect()
    par = lambda t: "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in re.sub(r"[\x00-\x08\x0b-\x1f]", "", t or "").split("\n"))
    cells = lambda r: "<w:tr>" + "".join(f"<w:tc>{par(str(v or ''))}</w:tc>" for v in r) + "</w:tr>"
    doc = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "<w:tbl>" + cells(names) + "".join(map(cells, top)) + "</w:tbl>"
    doc += "".join(par(t.h) + "".join(par(t[c]) for c in body) for t in texts) + "</w:body></w:document>"
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kind}"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", doc)


def audit_package(path: str, result: dict, views: list, reviews: list, history: list) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"result": result, "savedViews": views, "reviewLabels": reviews, "runHistory": history}, f, ensure_ascii=False, default=str)


def compacted(rows: DataFrame, total_bytes: int = 3_800_000) -> DataFrame:
    """Rows of a response whose long fields are clipped to shares of its budget, if the whole is too large; an option, not needed in Spark."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    if size <= total_bytes:
        return rows
    share = lambda budget, low, high: max(low, min(high, budget // n))
    limits = {"fetched_text": share(2_300_000, 900, 24_000), "extraction_trace_json": share(450_000, 450, 8_000), "evidence_json": share(300_000, 350, 6_000)}
    limits = {c: k for c, k in limits.items() if c in rows.columns}
    over = F.lit(False)
    for c, k in limits.items():
        over = over | (F.length(F.coalesce(c, F.lit(""))) > k)
    return rows.withColumn("_compacted", over).withColumns({c: clip(F.col(c), k) for c, k in limits.items()})


def newest(table: DataFrame, key: str, at: str, keep: int) -> DataFrame:
    """The latest row of each key, the newest ``keep`` of them: run history, saved views, prompt library."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc(at), key).limit(keep)


def append(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.write.mode("append").parquet(path)


def log_lines(rows: DataFrame) -> DataFrame:
    """(row_id, line): one line of progress per row, in the order of the rows."""
    return rows.select("row_id", F.format_string("%s %s: %s (%s)", F.coalesce("run_id", F.lit("")), F.col("row_id").cast("string"), F.coalesce("quality_label", F.lit("")), F.coalesce("recovery_route", F.lit("")))).toDF("row_id", "line")


