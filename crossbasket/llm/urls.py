"""URL filters: host and path rules, then a weighted vocabulary counted by Aho-Corasick.

A rule allows or blocks a host with all its subdomains below a path prefix; the longest one that
fits decides. Where none does, the URL's text is searched for all terms of a vocabulary at once: the
URLs of a batch stand in one string that an Aho-Corasick automaton reads in one pass, and numpy
checks the boundaries of its hits and counts them by URL. A strict term rejects by itself; soft
terms reject if several different ones weigh enough together. Percent escapes of printable ASCII are
read as what they stand for, once, and A-Z as a-z.

One pass over the table, no shuffle; rules and terms are parameters that every task holds. A null
URL has no host, path, rule or hit and is allowed; so is an empty one. Repeated rows give repeated
results, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm.batches import arrow_schema, map_batches, pieces
from crossbasket.llm.shared import LOWER, UPPER

_FOLD = str.maketrans(UPPER, LOWER)
_ESCAPE = re.compile("%([2-7][0-9A-Fa-f])")
_INSIDE = np.zeros(128, bool)  # what a whole term must not stand next to
_INSIDE[[ord(c) for c in LOWER + "0123456789"]] = True


class Rule(NamedTuple):
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(name: str, allow: bool) -> Rule:
    """``net/es/`` is the host ``net``, its subdomains, and paths from ``/es/`` on."""
    host, slash, path = name.partition("/")
    return Rule(host.translate(_FOLD), slash + path, allow)


class Term(NamedTuple):
    text: str
    weight: int  # 0 for a strict term
    whole: bool = True  # no letter a-z or digit next to it


def vocabulary(strict: Iterable[str] = (), soft: dict[str, int] | None = None, parts: Iterable[str] = ()) -> list[Term]:
    """Terms: strict ones as whole words, ``parts`` strict ones that count inside words too, soft ones by weight."""
    terms = [Term(t, 0) for t in strict] + [Term(t, 0, False) for t in parts]
    return terms + [Term(t, w) for t, w in (soft or {}).items()]


RULES = (
    rule("com/", True),
    rule("example.com/en/", False),
    rule("www.example.com/en/", True),
    rule("net/es/", False),
    rule("net/fr/", False),
)
LIMIT = 4
TERMS = tuple(
    vocabulary(
        strict=["casino", "casinos", "xxx", "escort", "escorts", "viagra", "cialis", "malware", "warez", "hentai"],
        parts=["porn", "xvideo", "sexcam"],
        soft={
            "ads": 2, "ad": 1, "adserver": 3, "track": 2, "tracker": 2, "tracking": 2, "click": 1, "clicks": 1, "popup": 2,
            "spam": 3, "farm": 1, "adult": 3, "x": 1, "sex": 3, "nude": 3, "cam": 1, "cams": 2, "dating": 2,
            "cheap": 2, "pill": 2, "pills": 2, "pharmacy": 1, "meds": 2, "rx": 2, "discount": 1, "replica": 2,
            "bet": 2, "bets": 3, "betting": 3, "poker": 2, "slots": 2, "jackpot": 3, "win": 1, "free": 1, "bonus": 2,
            "loan": 2, "loans": 2, "payday": 3, "crack": 1, "cracked": 2, "keygen": 3, "torrent": 2, "download": 1,
        },
    )
)


class UrlFilter:
    """Rules by host, and an automaton of terms."""

    def __init__(self, rules: Iterable[Rule], terms: Iterable[Term], limit: int):
        self.limit = limit
        self.rules: dict[str, list[Rule]] = {}
        for one in sorted(set(rules), key=lambda r: (-len(r.path), r.path, r.allow)):
            self.rules.setdefault(one.host, []).append(one)
        terms = list(dict.fromkeys(terms))
        if any(not t.text or t.text != t.text.translate(_FOLD) or "\n" in t.text for t in terms):
            raise ValueError("terms are non-empty, in small letters and within a line")
        if any(t.weight and not 0 < t.weight < limit for t in terms):
            raise ValueError("a soft term must weigh less than the limit")
        if len({t.text for t in terms}) < len(terms):
            raise ValueError("a term is there twice")
        self.lengths = np.array([len(t.text) for t in terms], np.int64)
        self.weights = np.array([t.weight for t in terms], np.int64)
        self.whole = np.array([t.whole for t in terms], bool)
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(term.text, i)
        self.automaton.make_automaton()

    def rule_of(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; a block wins a tie of one name."""
        best, rest = None, host
        while rest:
            for one in self.rules.get(rest, ()):
                if path.startswith(one.path):
                    # a longer host comes first, so only a longer name replaces it
                    if best is None or len(one.name) > len(best.name):
                        best = one
                    break
            rest = rest.partition(".")[2]
        return best

    def hits(self, urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each URL the number of hits, of different strict and of different soft terms, and the soft ones' weight."""
        n = len(urls)
        plain = [_plain(url) for url in urls]
        joined = "\n".join(plain)
        found = [*self.automaton.iter(joined)] if len(self.automaton) else []
        if not found:
            return tuple(np.zeros(n, np.int64) for _ in range(4))
        last, term = np.array(found, np.int64).T
        first = last - self.lengths[term] + 1
        codes = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = _INSIDE[np.minimum(codes, 127)] & (codes < 128)
        good = ~self.whole[term] | ~(inside[first] | inside[last + 2])
        first, term = first[good], term[good]
        starts = np.cumsum([0] + [len(text) + 1 for text in plain[:-1]])
        row = np.searchsorted(starts, first, side="right") - 1
        count = np.bincount(row, minlength=n)
        row, term = np.unique(np.stack([row, term]), axis=1)
        weight = self.weights[term]
        strict = np.bincount(row[weight == 0], minlength=n)
        soft = np.bincount(row[weight > 0], minlength=n)
        return count, strict, soft, np.bincount(row, weight, minlength=n).astype(np.int64)


def _plain(url: str) -> str:
    if "%" in url:
        url = _ESCAPE.sub(lambda m: m[0] if m[1] in ("20", "7F", "7f") else chr(int(m[1], 16)), url)
    return url.translate(_FOLD)


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host, A-Z lower-cased, and the path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    before = re.match("([^/?#]*)([^?#]*)", rest)
    return before[1].translate(_FOLD), before[2]


def judged(
    pages: DataFrame, rules: Iterable[Rule] = RULES, terms: Iterable[Term] = TERMS, limit: int = LIMIT
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and the counted hits of every row."""
    rules, terms = tuple(rules), tuple(terms)
    UrlFilter(rules, terms, limit)  # wrong parameters fail here and not in a task
    counts = ("n_hits", "n_strict", "n_soft", "soft_weight")
    schema = T.StructType(
        [
            T.StructField("page_id", pages.schema["page_id"].dataType),
            *[T.StructField(name, T.StringType()) for name in ("host", "path", "rule", "verdict")],
            *[T.StructField(name, T.LongType()) for name in counts],
        ]
    )
    out = arrow_schema(schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        url_filter = UrlFilter(rules, terms, limit)
        for batch in batches:
            for piece in pieces(batch, "url"):
                urls = piece.column(1).to_pylist()
                where = [host_and_path(url) for url in urls]
                counted = url_filter.hits([url or "" for url in urls])
                reject = (counted[1] > 0) | ((counted[2] > 1) & (counted[3] >= limit))
                fits = [url_filter.rule_of(*at) for at in where]
                allow = [not bad if one is None else one.allow for one, bad in zip(fits, reject)]
                columns = [
                    piece.column(0),
                    pa.array([host for host, _ in where], pa.string()),
                    pa.array([path for _, path in where], pa.string()),
                    pa.array([one and one.name for one in fits], pa.string()),
                    pa.array(["allow" if a else "block" for a in allow], pa.string()),
                    *[pa.array(c, pa.int64()) for c in counted],
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(pages.select("page_id", F.col("url").cast("string").alias("url")), judge, schema)


def _quoted(values: Iterable[str]) -> str:
    return ", ".join("('" + "', '".join(str(v).replace("'", "''") for v in row) + "')" for row in values)


def oracle_sql(rules: Iterable[Rule] = RULES, terms: Iterable[Term] = TERMS, limit: int = LIMIT) -> str:
    """The same in DuckDB's SQL, a regular expression for each term."""
    rows = _quoted((r.name, r.host, r.path, "allow" if r.allow else "block") for r in rules)

    def pattern(term: Term) -> str:
        text = re.escape(term.text)
        return f"(^|[^a-z0-9]){text}([^a-z0-9]|$)" if term.whole else text

    words = _quoted((t.text, pattern(t), t.weight) for t in terms)
    return rf"""
WITH rules(name, on_host, on_path, act) AS (VALUES {rows}),
terms(term, pattern, weight) AS (VALUES {words}),
p AS (
  SELECT row_number() OVER () AS rn, page_id, coalesce(url, '') AS url,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
u AS (
  SELECT rn, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
         translate(array_to_string(list_transform(regexp_extract_all(url, '%[2-7][0-9A-Fa-f]|[^%]+|%'), lambda x:
           CASE WHEN x[1] = '%' AND length(x) = 3 AND lower(x) NOT IN ('%20', '%7f')
                THEN chr(CAST('0x' || x[2:3] AS INTEGER)) ELSE x END), ''), '{UPPER}', '{LOWER}') AS plain
  FROM h),
fit AS (
  SELECT rn, arg_max(name, length(name)) AS rule, arg_max(act, length(name)) AS act
  FROM u JOIN rules ON (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, on_path)
  GROUP BY rn),
hit AS (
  SELECT rn, count(*) FILTER (weight = '0') AS n_strict, count(*) FILTER (weight <> '0') AS n_soft,
         CAST(sum(CAST(weight AS BIGINT)) AS BIGINT) AS soft_weight
  FROM u JOIN terms ON regexp_matches(plain, pattern) GROUP BY rn)
SELECT page_id, host, path, rule,
       coalesce(act, CASE WHEN n_strict > 0 OR (n_soft > 1 AND soft_weight >= {limit}) THEN 'block' ELSE 'allow' END)
         AS verdict,
       coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(soft_weight, 0) AS soft_weight
FROM u LEFT JOIN fit USING (rn) LEFT JOIN hit USING (rn)
"""
