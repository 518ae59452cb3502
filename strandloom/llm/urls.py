"""URL filters: rules are indexed by their rarest literal token; a URL's tokens fetch candidates, and only those are tried.

Native throughout. Rarity is counted over the tokens of all URLs. The index (one row per rule) joins the exploded tokens;
the fetched rules' regular expressions run on the host and path; the best match per URL is reduced by a map-side
combining aggregate. The rule list is a parameter on the driver; it is broadcast while it has at most BROADCAST_RULES rows
and joined by shuffle beyond that, where tokens that many URLs have are spread over tasks. URLs without host and path,
which no rule can fit, take no part in joins, and a URL that very many rows have is spread over tasks too.

Rules also come from filter lists (`read_rules`), in the usual line syntax: `||` before a domain, `|` at the beginning or end,
`*` for anything, `^` for a separator or the end, `@@` before an exception. Their literal tokens are the letters and digits
between separators; what an open end may go on with is none.

Defined results: a null URL, or one without `://`, has empty host and path and no rule; repeated rows are judged alike;
an empty table gives an empty table. Of rules that fit, site rules go before patterns, exceptions before others, then the
longest text, then the last by text.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import pick, spread_join, stored

BROADCAST_RULES = 20_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = "[^A-Za-z0-9]+"


class Rule(NamedTuple):
    """text names the rule. Site rules show in the result; patterns only give a verdict. tokens: whole literal tokens that
    every URL that fits has; without any, the rule is tried on every URL."""

    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    site: bool


def site(verdict: str, host: str, path: str) -> Rule:
    """For a host with its subdomains and a prefix of the path."""
    whole = path if not path or path[-1] == "/" else path[: path.rfind("/") + 1]  # the last segment may go on
    tokens = [x for x in re.split(_SPLIT, host + "/" + whole) if x]
    return Rule(host + path, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path) if path else '(/|$)'}", tuple(tokens), True)


def pattern(verdict: str, token: str) -> Rule:
    """For URLs whose path has the token as a segment, alone or with an extension."""
    return Rule(token, verdict, rf"/{re.escape(token)}(/|\.|$)", (token,), False)


def filter_rule(line: str) -> Rule | None:
    """A line of a filter list as a rule on host and path, or None: comments, headers, rules for parts of pages (`##`) and rules
    with options (`$`), which hang on more than the URL. Letters count as they are written, hosts are in lower case."""
    text = line.strip()
    if not text or text[0] in "![" or "##" in text or "#@#" in text or "$" in text:
        return None
    body = text.removeprefix("@@")
    domain, start = body.startswith("||"), body.startswith("|")
    end = body.endswith("|") and len(body) > 2
    body = body.removeprefix("||") if domain else body.removeprefix("|")
    body = re.sub(r"^[a-z]+://", "", body.removesuffix("|") if end else body)
    if not body.strip("*^"):
        return None
    regex = "".join(".*" if c == "*" else "([^A-Za-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    regex = (r"^([^/]*\.)?" if domain else "^" if start else "") + regex + ("$" if end else "")
    # a run of letters and digits is a whole token if neither * nor an open end can make it longer
    marked = ("/" if domain or start else "*") + body + ("/" if end else "*")
    tokens = re.findall(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", marked)
    return Rule(text, "allow" if text.startswith("@@") else "block", regex, tuple(tokens), False)


def read_rules(spark: SparkSession, path: str | list[str]) -> list[Rule]:
    """The rules of filter lists, each once, in order of their text. A list is read whole: it is a parameter."""
    lines = spark.read.text(path).distinct().collect()
    return sorted(r for x in lines if (r := filter_rule(x.value)))


#: What the method says of URLs that no site rule fits; all else is allowed.
PATTERNS = [pattern("block", t) for t in ("login", "signin", "signup", "cart", "checkout", "casino", "porn", "xxx", "search")]


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`(page_id, url, host, path)`. Host: behind the first `://` up to `/`, `?`, `#`; path: from there up to `?`, `#`."""
    src = pick(pages, **{"page_id": id_col, "url": url_col})
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    src = src.withColumn("rest", F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^?#]*)", 1))
    host = F.regexp_extract("rest", r"^([^/]*)", 1)
    return src.select("page_id", "url", F.translate(host, _UPPER, _UPPER.lower()).alias("host"), F.expr("substring(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1)").alias("path"))


def _tokens(text: Column) -> Column:
    """Distinct tokens, and an empty one that fetches rules without tokens."""
    return F.array_distinct(F.concat(F.split(text, _SPLIT), F.array(F.lit(""))))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`(page_id, host, path, rule, pattern, verdict)` of every row."""
    spark = pages.sparkSession
    urls = parsed(pages, id_col, url_col).withColumn("where", F.concat("host", "path"))
    small = len(rules) <= BROADCAST_RULES
    urls = stored(urls, "urls")
    listed = spark.createDataFrame(pa.table({
        "k": pa.array(range(len(rules)), pa.int32()), "text": pa.array([r.text for r in rules], pa.string()), "said": pa.array([r.verdict for r in rules], pa.string()),
        "regex": pa.array([r.regex for r in rules], pa.string()), "tokens": pa.array([list(r.tokens) or [""] for r in rules], pa.list_(pa.string())), "site": pa.array([r.site for r in rules], pa.bool_()),
    }))
    some = urls.filter(F.col("where") != "")
    seen = some.select("where", F.explode(_tokens(F.col("where"))).alias("token"))
    literal = listed.select("k", F.explode("tokens").alias("token"))
    held = literal.select("token").distinct()
    often = seen.join(F.broadcast(held) if small else held, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literal.join(often, "token", "left").groupBy("k").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = rarest.join(listed.drop("tokens"), "k")
    tried = seen.join(F.broadcast(index), "token") if small else spread_join(seen, stored(index, "index"), "token", F.col("where"))
    fits = tried.filter(F.expr("where rlike regex"))
    best = fits.groupBy("where").agg(F.max(F.struct("site", F.col("text").startswith("@@").alias("except"), F.length("text").alias("n"), "text", "said")).alias("best"))
    found = spread_join(some, best, "where", F.struct("page_id", "url"), "left")
    out = found.unionByName(urls.filter(F.col("where") == ""), allowMissingColumns=True)
    named = F.when(F.col("best.site"), F.col("best.text"))
    return out.select("page_id", "host", "path", named.alias("rule"), F.when(~F.col("best.site"), F.col("best.text")).alias("pattern"), F.coalesce("best.said", F.lit(default)).alias("verdict"))
