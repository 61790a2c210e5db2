"""URL filters: pattern rules indexed by their rarest literal token.

Rules are a table (rule, verdict, kind) of any size. Tokens are runs of two or more of a-z and 0-9 in a lower-cased URL. A
rule's literal tokens are those that every URL it fits must hold as whole tokens; the rule is filed under the one that the
fewest URLs of the table hold (of equals, the one in the fewest rules, then the longest). A URL fetches the rules filed under
its own tokens, and only their regular expressions run; rules without a literal token run on every URL.

Two kinds of rules: `path` rules, a host and the start of a path, fit the host, all its subdomains and the paths that start
with theirs, and the longest that fits decides; otherwise `pattern` rules decide, words in any place of host and path with `*`
between them for anything, allow before block and then the first by name; a URL that none fits is allowed.

Tokens are counted, and rules filed, by Spark. Filed rules go to the executors in slices of at most SLICE_CHARS characters,
one pass of the URLs for each slice; a pass hands the best rules found so far to the next.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end. A
null URL or one without `://` has an empty host and path and fits no rule of either kind. Repeated rows get equal results;
rules without a name are left out, and of rules with one name the first verdict by name counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.tables import near, stored

TOKEN = re.compile("[a-z0-9]{2,}")
JUDGED = "page_id long, host string, path string, rule string, rule_verdict string, pattern string, pattern_verdict string"
RULES = "rule string, verdict string, kind string"
SLICE_CHARS = 8 << 20
#: Words of hosts that publish spam, for callers that bring no pattern rules of their own.
SPAM = ("adult-x", "ads-track", "casino", "cheap-pills", "free*download*crack", "free-bets", "poker", "spam-farm")


def table_of(spark: SparkSession, paths: Iterable[tuple[str, str]] = (), patterns: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """A rule table from (rule, verdict) pairs."""
    rows = [(r, v, "path") for r, v in paths] + [(r, v, "pattern") for r, v in patterns]
    return spark.createDataFrame(rows, RULES)


def literals(rule: str, kind: str) -> list[str]:
    """Tokens that a URL must hold for the rule to fit it."""
    if kind == "pattern":
        return TOKEN.findall(rule.lower())
    host, _, path = rule.partition("/")
    # the path's last token may be the start of a longer one, and its case counts while tokens' does not
    return TOKEN.findall(host) + [m[0] for m in TOKEN.finditer(path.lower()) if m.end() < len(path)]


@lru_cache(maxsize=1 << 16)
def expression(rule: str, kind: str) -> re.Pattern:
    """What runs on host + path."""
    if kind == "pattern":
        parts = [p for p in rule.lower().split("*") if p]
        return re.compile("(?i:.*" + ".*".join(rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])" for p in parts) + ")", re.S)
    host, slash, path = rule.partition("/")
    return re.compile(rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path) if slash else '(?:/|$)'}", re.S)


def located(pages: DataFrame, url: str = "url") -> DataFrame:
    """page_id, host and path of every row."""
    part = lambda k: F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    return pages.select("page_id", F.translate(part(1), upper, upper.lower()).alias("host"), part(2).alias("path"))


def filed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, verdict, kind, token): each rule under the rarest of its tokens, null if it has none."""

    def with_tokens(batches):
        for batch in batches:
            tokens = [sorted(set(literals(r, k))) for r, k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.list_(pa.string()))], ["rule", "verdict", "kind", "tokens"])

    one = rules.where("rule IS NOT NULL").groupBy("rule", "kind").agg(F.min("verdict").alias("verdict")).select("rule", "verdict", "kind")
    listed = stored(one.mapInArrow(with_tokens, f"{RULES}, tokens array<string>"), "url-rules")
    exploded = listed.select("rule", "kind", F.explode("tokens").alias("token"))
    in_rules = stored(exploded.groupBy("token").agg(F.count("*").alias("in_rules")), "url-rule-tokens")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("([a-z0-9]{2,})")))
    counts = urls.select(F.explode(words).alias("token")).join(near(in_rules.select("token")), "token", "left_semi").groupBy("token").agg(F.count("*").alias("in_urls"))
    ranked = exploded.join(in_rules, "token").join(counts, "token", "left").select("rule", "kind", F.struct(F.coalesce("in_urls", F.lit(0)), "in_rules", -F.length("token"), "token").alias("rank"))
    rarest = ranked.groupBy("rule", "kind").agg(F.min("rank").alias("rank")).select("rule", "kind", "rank.token")
    return stored(listed.drop("tokens").join(rarest, ["rule", "kind"], "left"), "url-rules-filed")


def index_of(rows: Iterable) -> tuple[list[tuple[str, str, str]], dict[str, list[int]], list[int]]:
    """Rules, their numbers by the token that they are filed under, and those of rules without one."""
    rules, index, always = [], {}, []
    for k, (rule, verdict, kind, token) in enumerate(rows):
        rules.append((rule, verdict, kind))
        (index.setdefault(token, []) if token is not None else always).append(k)
    return rules, index, always


def _passed(urls: DataFrame, shared) -> DataFrame:
    """urls, JUDGED, with the rules of one slice considered."""

    def better_path(a, b):
        return a if b is None or a is not None and (len(a[0]), a[0]) >= (len(b[0]), b[0]) else b

    def better_pattern(a, b):
        return a if b is None or a is not None and (a[1] != "allow", a[0]) <= (b[1] != "allow", b[0]) else b

    def per_batch(batches):
        rules, index, always = shared.value
        for batch in batches:
            out = []
            for host, path, rule, rule_verdict, pattern, pattern_verdict in zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True):
                place = host + path
                best, other = rule and (rule, rule_verdict), pattern and (pattern, pattern_verdict)
                for k in {k for t in TOKEN.findall(place.lower()) for k in index.get(t, ())}.union(always) if place else ():
                    name, verdict, kind = rules[k]
                    if expression(name, kind).match(place):
                        best, other = (better_path((name, verdict), best), other) if kind == "path" else (best, better_pattern((name, verdict), other))
                out.append((*(best or (None, None)), *(other or (None, None))))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.string()) for c in columns)], [x.split()[0] for x in JUDGED.split(", ")])

    return urls.mapInArrow(per_batch, JUDGED)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row of pages(page_id, url): rule is the path rule that decides."""
    urls = located(pages, url)
    kept = filed(urls, rules)
    slices = max(1, -(-(kept.agg(F.sum(F.length("rule"))).first()[0] or 0) // slice_chars))
    none = F.lit(None).cast("string")
    found = urls.select("page_id", "host", "path", *(none.alias(c) for c in ("rule", "rule_verdict", "pattern", "pattern_verdict")))
    for k in range(slices):
        rows = kept.where(F.pmod(F.xxhash64("rule"), F.lit(slices)) == k).select("rule", "verdict", "kind", "token").collect()
        found = _passed(found, pages.sparkSession.sparkContext.broadcast(index_of(rows)))
        if k < slices - 1:
            found = stored(found, "url-judged")
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "pattern_verdict", F.lit("allow")).alias("verdict"), "pattern")
