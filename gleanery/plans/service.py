"""What surrounds a run on the driver: fetching rules, model requests, prompts, readiness, and cutting a manifest into chunks.

Nothing here opens a connection: fetchers, models, clocks and random sources are given by the caller.
"""

from __future__ import annotations

import json
import random
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_ROWS, CHUNK_BYTES = 25, 2_900_000
ERROR_CHARS = 2000
#: Longest waits in seconds by what went wrong, and the spread of the random part.
WAITS = {"rate": (45.0, 1.5), "server": (30.0, 1.2), "network": (25.0, 1.0)}
STRICTNESS = {
    "strict": "Take doubt as a no: thin proof, missing parts and any conflict with the summary cost many points.",
    "balanced": "Weigh accuracy against common sense, as fits a collection of uneven quality.",
    "creative": "Interpretation is welcome as long as each statement can be pointed to in the text.",
}
PROMPTS = {
    "ai-rubric": ("Judge every article for the aim: {goal}", "Check that this is the article and no error or log-in page; compare it with the summary and give 0 to 100 points; judge how complete and how relevant it is; quote the proof; send what is unclear to manual review."),
    "article-recovery": ("Give back the article's own words for the aim: {goal}", "Keep title, author, date, headings and quotations in their order; leave out menus, advertisements and notices; add nothing; report pages that are no article."),
    "summary-alignment": ("Compare the article with its summary for the aim: {goal}", "List topic, people, time and place on both sides; give 0 to 30 points for another story, 31 to 70 for a partial match, more for a close one; say why in a sentence."),
    "dataset-methods": ("Write the coding rules of a collection of articles for the aim: {goal}", "Say what is taken in and left out, which variables are coded, how duplicates and broken pages are found, and what reviewers note."),
    "custom": ("{goal}", "Write a prompt that can be used again: role, task, terms, limits, proof, failures and form of the answer."),
}


def safe_base_url(value: object) -> str | None:
    """An http(s) address without control characters, query, fragment and closing slash; None if it is none."""
    raw = re.sub(r"[\x00-\x1f\x7f-\x9f]", "", "" if value is None else str(value)).strip()
    try:
        u = urlsplit(raw)
        u.port  # raises on a broken port
    except ValueError:
        return None
    if u.scheme.lower() not in ("http", "https") or not u.hostname:
        return None
    return urlunsplit((u.scheme.lower(), u.netloc.lower(), u.path, "", "")).removesuffix("/")


def retry_after(value: str | None, now: datetime) -> float | None:
    """Milliseconds to wait by a header of seconds or a date, never negative; None if it says neither."""
    text = (value or "").strip()
    if re.fullmatch(r"[+-]?\d+(?:\.\d+)?", text):
        return max(0.0, float(text) * 1000)
    try:
        at = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    return max(0.0, (at.replace(tzinfo=at.tzinfo or timezone.utc) - now).total_seconds() * 1000)


def run_id(now: datetime, rng: random.Random) -> str:
    """The second of the start and five random letters or digits."""
    return f"run_{now.astimezone(timezone.utc):%Y%m%d%H%M%S}_{''.join(rng.choice(string.digits + string.ascii_lowercase) for _ in range(5))}"


def wait_for(kind: str, attempt: int, jitter: float) -> float:
    """Seconds before the next attempt: doubled each time, with a random part, up to the kind's longest; jitter is from 0 to 1."""
    longest, spread = WAITS[kind]
    return min(longest, 2.0**attempt + jitter * spread)


@dataclass(frozen=True)
class Answer:
    """What a fetcher brings: status, body and the header that asks to wait."""

    status: int
    body: str = ""
    retry_after: str | None = None


@dataclass(frozen=True)
class Outcome:
    ok: bool
    status: int
    body: str
    error: str


def fetched(fetch: Callable[[], Answer], retries: int, sleep: Callable[[float], None], now: Callable[[], datetime], rng: random.Random) -> Outcome:
    """Fetch with retries: limited rates wait as asked, refused ones return at once with their body, server errors and broken
    connections are tried again, and the last server error returns with its body."""
    status, error = 0, ""
    last = max(1, retries) - 1
    for attempt in range(last + 1):
        try:
            a = fetch()
        except Exception as e:  # any failure of a connection counts as one attempt
            error = str(e)
            if attempt < last:
                sleep(wait_for("network", attempt, rng.random()))
            continue
        status = a.status
        if a.status == 429:
            asked = retry_after(a.retry_after, now())
            error = "HTTP 429: the server limits the rate"
            if attempt < last:
                sleep(asked / 1000 if asked is not None else wait_for("rate", attempt, rng.random()))
        elif a.status in (401, 403):
            return Outcome(False, a.status, a.body, "the server refuses access")
        elif 500 <= a.status < 600 and attempt < last:
            sleep(wait_for("server", attempt, rng.random()))
        else:
            ok = 200 <= a.status < 300
            return Outcome(ok, a.status, a.body, "" if ok else f"HTTP {a.status}")
    return Outcome(False, status, "", error or "nothing was fetched")


def request(model: str, system: str, prompt: str) -> dict:
    """A chat request; models that reason take one message of the user and no temperature."""
    if re.match("o[134]", model, re.I):
        return {"model": model, "messages": [{"role": "user", "content": f"{system}\n\n{prompt}"}]}
    return {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "temperature": 0}


def connection(model: Callable[[str], str] | None, name: str = "") -> dict:
    """Whether a model answers."""
    try:
        if model is None:
            raise ValueError("no model was given")
        return {"ok": True, "message": f"{name or 'the model'} answers: {model('Answer with one word: ready').strip() or 'ready'}"}
    except Exception as e:
        return {"ok": False, "message": str(e)}


def prompt(goal: str, kind: str = "ai-rubric", audience: str = "a careful reader", strictness: str = "balanced", include: str = "", avoid: str = "", summary_column: str = "", model: Callable[[str], str] | None = None) -> dict:
    """A prompt from a template, refined by a model if one is given; a model that fails leaves the template's with a note."""
    if len(goal.strip()) < 3:
        raise ValueError("say what the prompt is for")
    task, rules = PROMPTS[kind]
    parts = [f"Role: {audience}", "Task: " + task.format(goal=goal.strip()), f"Rules: {rules}", f"Strictness: {STRICTNESS[strictness]}"]
    parts += [f"{k}: {v}" for k, v in (("Must include", include.strip()), ("Must avoid", avoid.strip())) if v]
    if kind == "ai-rubric" and summary_column:
        parts.append(f"The summary stands in the column {summary_column}.")
    local = "\n\n".join(parts)
    if model is None:
        return {"prompt": local, "source": "template", "note": ""}
    try:
        return {"prompt": model(f"Improve this prompt, keep its rules and stay under 650 words:\n\n{local}").strip() or local, "source": "model", "note": ""}
    except Exception as e:
        return {"prompt": local, "source": "template", "note": f"the model failed: {e}"}


def readiness(n_rows: int, url_column: str, group_column: str | None, requests_saved: int, enable_ai: bool, ai_ready: bool) -> list[dict]:
    """The four checks before a run."""
    return [
        {"label": "manifest", "ok": n_rows > 0, "note": f"{n_rows} rows" if n_rows else "no rows"},
        {"label": "url", "ok": bool(url_column), "note": url_column or "no column"},
        {"label": "grouping", "ok": bool(group_column), "note": f"{requests_saved} requests saved" if requests_saved else "optional"},
        {"label": "model", "ok": not enable_ai or ai_ready, "note": "on" if enable_ai else "off"},
    ]


def response(text: str) -> dict:
    """The object of a response; blank ones are empty, and what is no JSON is an error that says its beginning."""
    if not text.strip():
        return {}
    try:
        return json.loads(text)
    except ValueError:
        return {"error": text[:ERROR_CHARS]}


def message(payload: dict, fallback: str) -> str:
    return str(payload.get("error") or payload.get("message") or fallback)


def chunked(rows: DataFrame, order: str, max_rows: int = CHUNK_ROWS, max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """rows with ``chunk_id``: in their order, a chunk ends before it would have more than max_rows rows or max_bytes of JSON.

    Chunks are filled within ranges of the order, so each range is one task; a single row beyond the limit is an error.
    """
    at = rows.columns.index(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n, size, first = 0, 0, 0, None
        for b in batches:
            ids = []
            for row in b.to_pylist():
                bytes_ = len(json.dumps(row, ensure_ascii=False, default=str).encode()) + 1
                if bytes_ > max_bytes:
                    raise ValueError(f"row {row[order]} has {bytes_} bytes of JSON; a chunk holds {max_bytes}")
                if n and (n >= max_rows or size + bytes_ > max_bytes):
                    chunk, n, size = chunk + 1, 0, 0
                if first is None:
                    first = list(row.values())[at]
                n, size = n + 1, size + bytes_
                ids.append(f"{first}-{chunk}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.string())], names=[*b.schema.names, "chunk_id"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", chunk_id string"
    return rows.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, schema)
