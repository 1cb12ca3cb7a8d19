"""Problems 5 and 6: the main body of a page, and pages or texts that are left-overs of a template.

A text is laid out first: markup goes through the tree builder and renderer of ``gleanery.functions.html``, which keep the
source lines of every visible line and whether it stands in an element beside the main body; a text that is rendered
already gets the same lines from its own layout (blank lines, list marks, rows of cells, lists under a heading). A line's *skeleton* is
its letters in lower case after tokens with figures are dropped and the site's own name is replaced by a slot, so the copies
of one template line on many sites fall together: this aligns the records of a template. Besides its skeleton a line may
recur by its lead words, its *shape* (names and figures replaced by slots) or its *frame* (the letters around its one name).

What recurs is decided for each site by itself, so a site is judged alike in a small and a large corpus: a key is furniture
if on some site it stands in at least SITE_STORIES stories and in SITE_SHARE of them (on two sites, in half of that), then it is on all sites. Facts on where
its lines stand, counted over the whole corpus, tell its kind:

* set apart by blank lines: a subhead or closing credit of stories;
* followed by two or more unpunctuated lines: the head of a side list;
* on pages without a story, on several sites: a whole-page template, that is an error page or a notice;
* punctuated, set apart, the same on several sites, and often beside other such lines or on pages without a story: a default of
  the template's body, that is filler. Words that stand mostly on pages with such lines are filler words.

Stories are told apart by their longest paragraph, so copies of one story never make its sentences recur. The recurring keys are looked up
in a broadcast table behind a count of its rows, beyond it by a join on the key; both ways give the same rows.

Null and empty texts give no lines. Repeated rows come out as often as they came in. Only named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import html
from gleanery.functions.urls import page_domain
from gleanery.llm.arrow import map_rows
from gleanery.session import broadcastable, checkpointed

#: A key recurs on a site if it stands in so many of its stories and in this share of them; half the share is enough on two sites.
SITE_STORIES, SITE_SHARE = 3, 0.03
#: An error template or a filler line stands on so many sites, in so many texts.
SITES, ERROR_STORIES, FILLER_STORIES = 2, 3, 6
APART, LEAD, LISTHEAD, ERROR, FILLER_LEAD = 0.3, 0.8, 0.85, 0.7, 0.6
#: A page has a story if it has a sentence of so many characters.
STORY_CHARS = 100
#: A line of more characters recurs by its skeleton only.
SHORT = 200
#: Recurring keys of up to so many rows are broadcast, about 100 bytes each in a worker.
BROADCAST_KEYS = 200_000
SITE = "∎"

_letters = re.compile(r"[\W\d_]+")
_figures = re.compile(r"\d+")
_digit = re.compile(r"\d").search
_closed = re.compile(r"[.!?:…][\"”»’'“)\]]*\s*(?:»|\(\d+\))?$").search
_ornament = "•*≡–—- \t»\r\v\f\xa0"
_menu = re.compile(r"\s*(?:\s[|·/>]\s|\||·)\s*")
_lead = re.compile(r"^(\S+(?: \S+){0,2}?) ?(?:: | > | → | · | » )(?=\S)")
_name = re.compile(r"[^\W\d_][\w'’-]*")
_label = re.compile(r"[^\d.]*")
_ascii_rest = bytes(c for c in range(128) if not chr(c).isalpha())


def site_name(domain: str | None) -> str:
    """The letters of a domain's first label before any figure."""
    return _label.match(domain or "")[0].replace("-", "")


def letters(line: str) -> str:
    """The letters of a line in lower case."""
    k = line.lower().encode("utf-8", "replace").translate(None, _ascii_rest).decode()
    return k if k.isascii() or k.isalpha() else _letters.sub("", k)


def _skeleton(line: str, site: str) -> str:
    k = letters(" ".join(w for w in line.split() if w.isalpha() or not _digit(w)) if _digit(line) else line)
    if len(site) > 4:
        k = k.replace(site, SITE) if site in k else k.replace(site[:-1], SITE)
    return k


_cached = lru_cache(30_000)(_skeleton)


def skeleton(line: str, site: str) -> str:
    """A line's letters in lower case, figured tokens dropped, the site's name a slot."""
    return _cached(line, site) if len(line) < 100 else _skeleton(line, site)


def key_of(skel: str) -> int:
    return xxhash.xxh3_64_intdigest(skel) - (1 << 63)


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def closed(line: str) -> bool:
    """Whether a line ends like a sentence."""
    s = line.strip()
    return len(s) >= 25 and _closed(s, len(s) - 12) is not None


def bare(line: str) -> str:
    """A line without marks and ornaments around it."""
    return line.strip(_ornament)


def cells(s: str) -> list[str]:
    """The cells of a line that is a row of two or more short ones, as menus and paths are; else none."""
    if "|" in s or "·" in s or " / " in s or " > " in s:
        parts = [p for p in _menu.split(s) if p]
        if len(parts) >= 2 and all(p.count(" ") < 5 for p in parts):
            return parts
    return []


def teaser(s: str) -> str:
    """The one to three words before a colon, arrow or dot at a bare line's start; '' if there are none."""
    m = _lead.match(s)
    return m[1] if m else ""


def shaped(s: str) -> str:
    """A line's form: its first word and its capitalised words are names, runs of names and of figures become one slot each."""
    out: list[str] = []
    for i, w in enumerate(_figures.sub("0", s).split()):
        m = _name.search(w)
        if m and (i == 0 or m[0][0].isupper()):
            w = w[: m.start()] + "N" + w[m.end() :]
        if w == "N" and out and out[-1] == "N":
            continue
        if w[:1] == "N" and out and out[-1] == "N":
            out.pop()
        out.append(w)
    return " ".join(out)


def frame(s: str) -> tuple[str, str] | None:
    """The letters before the first and after the last name of a bare line, where a name is a capitalised word after the first; None without one.

    A line all in capitals or small letters shows no names.
    """
    words = s.split()
    if not 3 <= len(words) <= 16 or s.isupper() or s.islower():
        return None
    names = [i for i, w in enumerate(words) if i and w[:1].isupper()]
    if not names or names[0] < 2 or names[-1] - names[0] > 4:
        return None
    before, after = letters(" ".join(words[: names[0]])), letters(" ".join(words[names[-1] + 1 :]))
    return (before, after) if len(before) + len(after) >= 10 else None


def keys_of(s: str, site: str, ends: bool, frames: bool = True) -> list[tuple[int, str]]:
    """(key, text) of all by which a bare line may recur besides its skeleton, or all but its frame."""
    return _keys_cached(s, site, ends, frames) if len(s) < 100 else _keys_of(s, site, ends, frames)


def _keys_of(s: str, site: str, ends: bool, frames: bool) -> list[tuple[int, str]]:
    out = []
    at = s.find(": ", 0, 160)
    if at > 0 and _digit(s, 0, at) and s.count(" ", 0, at) < 9:
        out.append(f"{shaped(s[:at])}:")
    if not ends:
        if len(s) <= 60 and s.count(" ") < 6 and _digit(s):
            out.append(f"{shaped(s)}#")
        if t := teaser(s):
            out.append(f"{skeleton(t, site)}>")
        if frames and (f := frame(s)):
            out.append(f"{f[0]}~{f[1]}")
    return [(key_of(x), x) for x in out]


_keys_cached = lru_cache(30_000)(_keys_of)


@lru_cache(30_000)
def slots_of(s: str) -> list[int]:
    """Keys of the frames that a bare line would fill with nothing, a variable's name or a default."""
    words = s.split()
    if not 3 <= len(words) <= 16:
        return []
    out = [key_of(f"~~{letters(s)}")]
    for i, w in enumerate(words):
        if i and letters(w) in UNFILLED:
            out.append(key_of(f"{letters(' '.join(words[:i]))}~{letters(' '.join(words[i + 1 :]))}"))
    return out


class Page:
    """The visible lines of a text, with their source lines and whether they stand beside the main body by markup."""

    __slots__ = ("lines", "sources", "aside")

    def __init__(self, text: str):
        if html.has_markup(text):
            rows = html.render_lines(html.parse(text))
            self.lines, self.sources = [r.text for r in rows], [list(r) for r in rows]
            self.aside = [r.aside for r in rows]
            if all(a or not x for a, x in zip(self.aside, self.lines)):
                self.aside = [False] * len(rows)  # all in one such element: it is the page's own frame
        else:
            self.lines = lines_of(text)
            self.sources, self.aside = None, None

    def numbers(self, text: str, gone: list[int]) -> list[int]:
        """Source lines that hold letters and nothing but the given visible lines; of marked-up texts also those that show nothing."""
        if self.sources is None:
            return gone
        out = set(gone)
        kept = {n for i, of in enumerate(self.sources) if i not in out for n in of}
        return [n for n, x in enumerate(lines_of(text)) if n not in kept and letters(x)]


#: What a line is where it stands: set apart before running text, the head of a list, behind a blank line, a sentence without the site's name, on a page without a story.
FLAGS = ("apart", "heads", "lead", "ends", "storyless")


def facts(page: Page, site: str, text: str, light: bool = False) -> tuple[int, list[tuple[int, int, int]]]:
    """The story's id, and for each line with letters and each of its keys (key, filler's hash, FLAGS as bits); with ``light``
    only for lines of up to SHORT characters and without frames."""
    lines = page.lines
    n = len(lines)
    blank = [not x or x.isspace() for x in lines]
    ends = [not y and closed(x) for x, y in zip(lines, blank)]
    plain = [not y and not e and x.count(" ") >= 2 for x, y, e in zip(lines, blank, ends)]
    storyless = not any(e and len(x) >= STORY_CHARS for x, e in zip(lines, ends))
    out = []
    for i in range(n):
        line = lines[i]
        if blank[i] or light and len(line) > SHORT or not (skel := skeleton(line, site)):
            continue
        lead = i > 0 and blank[i - 1]
        apart = False
        if lead and i < n - 1 and blank[i + 1]:
            j = i + 2
            while j < n and blank[j]:
                j += 1
            apart = j < n and ends[j]
        heads = i + 2 < n and plain[i + 1] and plain[i + 2]
        sentence = lead and SITE not in skel and _closed(line.rstrip(), max(0, len(line) - 12)) is not None
        alone = storyless and skel != SITE and not cells(line)
        out.append((key_of(skel), 0, apart | heads << 1 | lead << 2 | sentence << 3 | alone << 4))
        if len(line) <= SHORT and not line.startswith("- "):
            s = bare(line)
            for k, x in keys_of(s, site, ends[i], not light):
                if "~" not in x:
                    out.append((k, 0, 0))
                    continue
                if light:
                    continue
                before, _, after = x.partition("~")
                whole = letters(s)
                fill = key_of(whole[len(before) : len(whole) - len(after)])
                out += [(k, fill, 0), (key_of(f"~~{before}{after}"), fill, 0)]
    longest = max((x for i, x in enumerate(lines) if i and blank[i - 1]), key=len, default="") or max(lines, key=len, default="")
    return key_of(longest if len(longest) > 100 else text), out


FURNITURE, BODY, HEAD, FILLER, ERRORS, SLOT = range(6)


def labelled(page: Page, site: str, kinds: dict[int, int]) -> list[tuple[str, str]]:
    """(label, skeleton) of each line; labels are '' without letters, 'story', or what a line beside the story is: 'head' of a
    side list, its 'item', 'teaser', 'furniture', 'menu', 'error', or 'beside' by its markup."""
    lines = page.lines
    out, listing, last = [], False, ""
    for i, line in enumerate(lines):
        if not line or line.isspace():
            listing, last = False, ""
            out.append(("", ""))
            continue
        skel = skeleton(line, site)
        if not skel and not letters(line):
            out.append(("", ""))
            continue
        ends, s = closed(line), bare(line)
        kind = kinds.get(key_of(skel)) if skel else None
        if page.aside and page.aside[i]:
            label = "beside"
        elif line.startswith("- ") and not listing and last == "story":
            label = "story"  # a list of the story goes on from its text
        elif kind == HEAD:
            label = "head"
        elif kind == ERRORS:
            label = "error"
        elif kind == FURNITURE:
            label = "furniture"
        elif kind is not None:
            label = "story"
        elif not ends and len(c := cells(s)) >= 2 and (len(c) > 2 or all(kinds.get(key_of(skeleton(p, site))) == FURNITURE for p in c)):
            label = "menu"
        elif len(line) <= SHORT and any(kinds.get(k) in (FURNITURE, SLOT) for k, _ in keys_of(s, site, ends)):
            label = "teaser"
        elif ends:
            label = "story"
        elif SITE in skel:
            label = "furniture"
        else:
            label = "item" if listing else "story"
        listing = label in ("head", "item")
        last = label
        out.append((label, skel))
    return out


def keys_asked(page: Page, site: str) -> set[int]:
    """All keys by which the lines of a page may be looked up."""
    out = set()
    for line in page.lines:
        if not line or line.isspace():
            continue
        if skel := skeleton(line, site):
            out.add(key_of(skel))
        s = bare(line)
        out.update(k for k, _ in keys_of(s, site, closed(line)))
        out.update(key_of(skeleton(p, site)) for p in cells(s))
        if len(line) <= 100:
            out.update(slots_of(s))
    return out


def scan(df: DataFrame, key: str, text: str, domain: Column | None) -> DataFrame:
    d = page_domain() if domain is None else domain
    return df.where(F.length(text) > 0).select(F.col(key), F.coalesce(d, F.lit("")).alias("_domain"), F.col(text).alias("_text"))


def recurring(texts: DataFrame, light: bool = False) -> DataFrame:
    """(key, kind): the recurring keys of the corpus, checkpointed. A story counts once for a key, whatever copies it has."""
    names = ["key", "site", "story", "low", "high", "flags"]

    def run(batches):
        import pyarrow as pa

        seen: dict[tuple[int, int, int], list[int]] = {}

        def flush():
            cols = [*zip(*seen)] or [(), (), ()]
            cols += [[v[i] for v in seen.values()] for i in range(3)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for b in batches:
            for d, t in dict.fromkeys(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                story, rows = facts(Page(t), site_name(d), t, light)
                site = key_of(d)
                for k, fill, flags in rows:
                    v = seen.get((k, site, story))
                    if v is None:
                        seen[k, site, story] = [fill, fill, flags]
                    else:
                        if fill < v[0]:
                            v[0] = fill
                        if fill > v[1]:
                            v[1] = fill
                        v[2] |= flags
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    rows = texts.select("_domain", "_text").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    by_story = rows.groupBy("key", "site", "story").agg(*ends, F.bit_or("flags").alias("flags"))
    counted = [F.sum(F.shiftright("flags", i).bitwiseAND(1)).alias(c) for i, c in enumerate(FLAGS)]
    by_site = by_story.groupBy("key", "site").agg(F.count("*").alias("stories"), *ends, *counted)
    totals = checkpointed(site_stories(texts))
    totals = F.broadcast(totals) if broadcastable(totals, BROADCAST_KEYS) else totals
    reached = lambda least: (F.col("stories") >= SITE_STORIES) & (F.col("stories") >= least * F.coalesce("total", F.lit(0)))
    here = F.max(reached(SITE_SHARE)) | (F.count_if(reached(SITE_SHARE / 2)) >= 2)
    by_key = by_site.join(totals, "site", "left").groupBy("key").agg(here.alias("here"), F.count("*").alias("sites"), F.sum("stories").alias("stories"), *ends, *(F.sum(c).alias(c) for c in FLAGS))
    share = lambda c: F.col(c) / F.col("stories")
    spread = F.col("sites") >= SITES
    story = (share("apart") > APART) | (share("lead") > LEAD)
    kind = (
        F.when(spread & (F.col("stories") >= ERROR_STORIES) & (share("storyless") >= ERROR), ERRORS)
        .when(spread & (F.col("stories") >= FILLER_STORIES) & (share("ends") >= FILLER_LEAD) & (share("lead") >= FILLER_LEAD), FILLER)
        .when(~F.col("here"), None)
        .when(story, BODY)
        .when(share("heads") > LISTHEAD, HEAD)
        .when((F.col("low") != 0) & (F.col("low") < F.col("high")), SLOT)
        .otherwise(FURNITURE)
    )
    return checkpointed(by_key.select("key", kind.alias("kind")).where("kind is not null"))


def site_stories(texts: DataFrame) -> DataFrame:
    """(site, total): the distinct texts of each site."""
    copies = texts.select("_domain", F.xxhash64("_text").alias("h")).distinct().groupBy("_domain").agg(F.count("*").alias("total"))
    return map_rows(copies, ["_domain", "total"], lambda: lambda d, n: ([key_of(x) for x in d], n), "site long, total long")


class Lookup:
    """How the kinds of a text's keys are found: a broadcast table, or a column joined to the texts.

    ``texts`` has the columns ``_domain``, ``_text`` and, joined, ``_kinds``; ``of(kinds column's value)`` is the table to look up in.
    """

    def __init__(self, texts: DataFrame, table: DataFrame, asked: Callable[[str, str], set[int]], limit: int = BROADCAST_KEYS):
        self.columns = ["_domain", "_text"]
        if broadcastable(table, limit):
            self.shared = texts.sparkSession.sparkContext.broadcast({r.key: r.kind for r in table.collect()})
            self.texts = texts
            return

        def batch(domains, values):
            copies, keys = [], []
            for d, t in zip(domains, values):
                own = asked(t, site_name(d))
                copies += [copy_of(d, t)] * len(own)
                keys += own
            return copies, keys

        self.shared = None
        wanted = map_rows(texts, ["_domain", "_text"], lambda: batch, "copy long, key long").distinct()
        found = wanted.join(table, "key").groupBy("copy").agg(F.collect_list(F.struct("key", "kind")).alias("_kinds"))
        others = [c for c in texts.columns if c not in self.columns]
        keyed = map_rows(texts, [*others, *self.columns], lambda: lambda *c: ([copy_of(d, t) for d, t in zip(c[-2], c[-1])], *c), "copy long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*others, *self.columns).schema))
        self.texts = keyed.join(found, "copy", "left").drop("copy")
        self.columns = [*self.columns, "_kinds"]

    @staticmethod
    def reader(shared) -> Callable[..., dict[int, int]]:
        """In a worker: the table for one text, given what its further columns hold."""
        if shared is None:
            return lambda found=None: {x["key"]: x["kind"] for x in found or ()}
        table = shared.value
        return lambda *_: table


def copy_of(domain: str, text: str) -> int:
    return key_of(f"{domain}\n{text}")


def looked_up(texts: DataFrame, limit: int = BROADCAST_KEYS, light: bool = False) -> Lookup:
    return Lookup(texts, recurring(texts, light), lambda t, site: keys_asked(Page(t), site), limit)


#: Names of a story's variables, by which the ways of writing a variable are found, and what is printed for a missing value.
NAMES = set("title headline name byline author date summary caption section body dek story article content category subtitle teaser".split())
DEFAULTS = set("undefined null none nan nil tbd tba todo untitled placeholder".split())
UNFILLED = NAMES | DEFAULTS
#: What formatting functions leave where a value is missing.
PRINTED = [("[object Object]", re.compile(r"\[object Object\]")), ("{", re.compile(r"\{\d+\}[^{}\n]{1,40}\{\d+\}")), ("undefined", re.compile(r"\bundefined \w+ of undefined\b"))]
#: A wrapper is a way of writing a variable if it is seen around so many of NAMES; those of the usual template languages need one.
WRAP_NAMES = 3
#: How the usual template languages begin a variable.
LANGUAGES = ("{{", "{%", "<%=", "<%", "${", "#{")
#: A filler word stands in this share of the pages with filler lines, and this share of its own pages have such lines.
FILLER_PAGES, FILLER_OWN, FILLER_WORDS = 0.01, 0.3, 0.7
#: A filler line stands in this share of the pages that have one, and on this share of its pages in the company of filler.
FILLER_LINE_PAGES, FILLER_COMPANY = 0.002, 0.3
#: Rest of an error page: so many words at most.
REST_WORDS = 30

_words = re.compile(r"[^\W\d_]+").findall
_marks = "{[<$#%@*~^=`+_}"
_twice = re.compile(r"(?<![^\W_])([A-Z])\1[A-Za-z]").search
_odd = r"[{}\[\]<>$#%@*~^=`+|]"
_wrap = re.compile(
    rf"(?P<before>(?:{_odd}{{1,3}}[|(]?|(?<!\w)(?:__|(?-i:(?P<twice>[A-Z])(?P=twice))))=?)(?P<inner>\s?(?:[A-Za-z]+[ ._:]){{0,3}}?)(?P<name>{'|'.join(sorted(NAMES, key=len, reverse=True))})"
    rf"(?P<rest>(?:[ ._:](?!_)[A-Za-z]+){{0,3}}?)(?P<after>\s?(?:\|?{_odd}{{1,3}}|__|(?P=twice){{2}}|\)))",
    re.I,
)
_capitals = re.compile(r"[A-Z]{3,}")


def wrapped(text: str) -> set[tuple[str, str, str]]:
    """(before, after, name): the marks around the names of NAMES in a text; fixed words in capitals are part of the marks."""
    out = set()
    if not any(c in text for c in _marks) and not _twice(text):
        return out
    for m in _wrap.finditer(text):
        before, after = m["before"], m["after"].strip()
        if m["name"].isupper():
            before += "".join(f"{w} " for w in _capitals.findall(m["inner"]))
            after = "".join(f" {w}" for w in _capitals.findall(m["rest"])) + after
        out.add((before, after, m["name"].lower()))
    return out


def way(before: str, after: str) -> str:
    """The pattern of a wrapper around one to four words."""
    edge = lambda s, x: rf"(?<!\w){s}" if x[:1].isalnum() or x[:1] == "_" else s
    return edge(re.escape(before.rstrip()), before) + r"\s?[A-Za-z]+(?:[ ._:][A-Za-z]+){0,3}?\s?" + re.escape(after.lstrip())


class Learned:
    """What marks left-overs: filler lines by key, filler words, and the ways of writing a variable, each with its first letters."""

    def __init__(self, lines: set[int], words: set[str], ways: list[tuple[str, re.Pattern]]):
        self.lines, self.words, self.ways = lines, words, [*PRINTED, *ways]

    def written(self, text: str) -> list[re.Pattern]:
        """The patterns of variables that a text holds."""
        if not any(c in text for c in _marks) and "undefined" not in text and not _twice(text):
            return []
        return [p for start, p in self.ways if start in text and p.search(text)]


def learned(texts: DataFrame, look: Lookup) -> Learned:
    """Filler, and the wrappers seen around WRAP_NAMES of NAMES.

    There are at most (lines per page) / FILLER_LINE_PAGES filler lines and (words per page) / FILLER_PAGES filler words,
    whatever the corpus.
    """
    shared = look.shared

    def near(batches):
        import pyarrow as pa

        kinds_of = Lookup.reader(shared)
        counts: dict[str, list[int]] = {"": [0, 0]}
        for b in batches:
            rows = [c.to_pylist() for c in b.columns]
            times: dict[tuple[str, str], list[int]] = {}
            for i, x in enumerate(zip(rows[0], rows[1])):
                times.setdefault(x, [i, 0])[1] += 1
            for (d, t), (i, weight) in times.items():
                kinds, site = kinds_of(*(c[i] for c in rows[2:])), site_name(d)
                lines = Page(t).lines
                own = {k for x in lines if len(x) <= SHORT and x.rstrip()[-1:] in ".!?" and kinds.get(k := key_of(skeleton(x, site))) == FILLER}
                if own:
                    company = len(own) > 1 or not any(len(x) >= STORY_CHARS and closed(x) for x in lines)
                    for w in {"", *(w for w in t.lower().split() if w.isalpha()), *map(str, own)}:
                        n = counts.setdefault(w, [0, 0])
                        n[0] += weight
                        n[1] += weight * company
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([n[i] for n in counts.values()], pa.int64()) for i in (0, 1))], names=["word", "n", "company"])

    beside = look.texts.select(*look.columns).mapInArrow(near, "word string, n long, company long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("company").alias("company"))
    beside = checkpointed(beside)
    pages = beside.where("word = ''").agg(F.sum("n")).first()[0] or 0
    is_key = F.col("word").rlike("^-?[0-9]+$")
    lines = {int(r.word) for r in beside.where(is_key & (F.col("company") >= FILLER_COMPANY * F.col("n")) & (F.col("n") >= FILLER_LINE_PAGES * pages)).collect()}
    likely = {r.word: r.n for r in beside.where(~is_key & (F.col("word") != "") & (F.col("n") >= max(2, FILLER_PAGES * pages))).collect()} if pages else {}
    asked = texts.sparkSession.sparkContext.broadcast(frozenset(likely))

    def everywhere(batches):
        import pyarrow as pa

        words = asked.value
        counts: dict[tuple[str, str, str], int] = {}
        for b in batches:
            for t, weight in Counter(b.column(0).to_pylist()).items():
                if words:
                    for w in words.intersection(t.lower().split()):
                        counts["", w, ""] = counts.get(("", w, ""), 0) + weight
                for x in wrapped(t):
                    counts[x] = counts.get(x, 0) + weight
        cols = [*zip(*counts)] or [(), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(list(counts.values()), pa.int64())], names=["before", "after", "name", "n"])

    totals = texts.select("_text").mapInArrow(everywhere, "before string, after string, name string, n long").groupBy("before", "after")
    rows = totals.agg(F.sum("n").alias("n"), F.count_distinct("name").alias("names")).where((F.col("before") == "") | (F.col("names") >= WRAP_NAMES) | F.col("before").isin(*LANGUAGES)).collect()
    words = {r.after for r in rows if not r.before and likely.get(r.after, 0) >= FILLER_OWN * r.n}
    return Learned(lines, words, [(b.rstrip(), re.compile(way(b, a))) for b, a in sorted((r.before, r.after) for r in rows if r.before)])


def is_filler(line: str, skel: str, known: Learned) -> bool:
    """Whether a line is a filler line, or FILLER_WORDS of its words and one of the first five are filler words."""
    if known.lines and skel and len(line) <= SHORT and key_of(skel) in known.lines:
        return True
    if not known.words or known.words.isdisjoint(line[:200].lower().split(None, 5)[:5]):
        return False
    own = _words(line.lower())
    return len(own) >= 5 and sum(w in known.words for w in own) >= FILLER_WORDS * len(own)


def without(patterns: list[re.Pattern], line: str) -> str:
    for p in patterns:
        line = p.sub("", line)
    return line


def leftovers(page: Page, text: str, site: str, kinds: dict[int, int], known: Learned) -> tuple[str, bool, list[str]]:
    """(what left-over of a template the text holds, whether it is nothing else, labels of its lines). Left-overs are 'variable',
    'slot', 'filler', 'error' or ''."""
    found = labelled(page, site, kinds)
    filler = False
    visible = text if page.sources is None else "\n".join(page.lines)
    written = known.written(visible)
    slot = False
    rest: list[str] = []
    for line, (label, skel) in zip(page.lines, found):
        if not slot and skel and len(line) <= 100 and not closed(line):
            slot = any(kinds.get(k) == SLOT for k in slots_of(bare(line)))
        if label == "story" and skel:
            if is_filler(line, skel, known):
                filler = True
            elif not written or without(written, line).strip():
                rest.append(line)
    error = any(x == "error" for x, _ in found)
    short = sum(len(x.split()) for x in rest) <= REST_WORDS
    whole = (filler or error) and not rest or error and short and not any(map(closed, rest))
    error = error and whole
    return "variable" if written else "slot" if slot else "filler" if filler else "error" if error else "", whole, [x[0] for x in found]


def judged(df: DataFrame, key: str = "result_id", text: str = "fetched_text", domain: Column | None = None, limit: int = BROADCAST_KEYS) -> DataFrame:
    """(key, leftover, whole, furniture array<int>, reasons array<string>, body): a row for each non-empty text.

    leftover names what is left of a template, '' for nothing. furniture are the lines beside the main body, numbered as in the
    given text also where it is marked up, with the reason of each. body is the main body, '' for error pages and filler.
    """
    texts = scan(df, key, text, domain)
    look = looked_up(texts, limit)
    shared, known = look.shared, texts.sparkSession.sparkContext.broadcast(learned(texts, look))
    kind = df.schema[key].dataType.simpleString()

    def make():
        kinds_of, found_out = Lookup.reader(shared), known.value

        def batch(keys, domains, values, *further):
            done: dict[tuple[str, str], tuple] = {}
            for i, (d, t) in enumerate(zip(domains, values)):
                if (d, t) in done:
                    continue
                page = Page(t)
                a, whole, found = leftovers(page, t, site_name(d), kinds_of(*(c[i] for c in further)), found_out)
                gone = [] if whole else [j for j, x in enumerate(found) if x not in ("", "story")]
                own = [] if whole else page.numbers(t, gone)
                body = "" if whole else re.sub(r"\n{3,}", "\n\n", "\n".join(x for x, y in zip(page.lines, found) if y in ("", "story"))).strip()
                done[d, t] = a, whole, own, [found[j] for j in gone] if page.sources is None else ["beside"] * len(own), body
            left, wholes, numbers, reasons, bodies = zip(*(done[x] for x in zip(domains, values)))
            return keys, left, wholes, numbers, reasons, bodies

        return batch

    return map_rows(look.texts, [key, *look.columns], make, f"{key} {kind}, leftover string, whole boolean, furniture array<int>, reasons array<string>, body string")
