"""Operator 5, URL filters: explicit rules, else logistic regression on hashed character n-grams of host and path.

DataFrame functions only. Features are the n-grams of `host` and of `path`, each marked by its part, hashed to
SLOTS; a URL's value for a slot is how often it occurs, over the root of the number of n-grams. Scoring sums
weights from a literal array inside one expression, with no shuffle. Training is batch gradient descent on the
driver over the small labelled table that labelled() makes up from families of words and from traits of names
(hyphens, digits, cheap domains); pages have ordinary paths, so that the name decides.

Rules come first. A rule is a host with a path; it fits that host and its subdomains if the URL's path starts
with the rule's. The longest fitting rule decides.

Defined results: null, or no `://`: host and path are empty, no rule fits, and the URL is allowed, as the model
has nothing to go by. Only A-Z of the host is lower-cased. Very long URLs are read whole. Repeated rows give
repeated rows; an empty table gives an empty one; columns besides page_id and url are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import ASCII_LOWER, LOWER, UPPER, table

#: Rule -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

SLOTS = 1 << 14
SIZES = (1, 3, 4)
EPOCHS = 800
RATE = 4.0
MOMENTUM = 0.9
DECAY = 1e-5
#: What a spam row weighs against an ordinary one.
SPAM_WORTH = 2.0
#: Weights are multiples of this, so that their sums are exact in any order.
GRAIN = 2.0**-20
#: A URL is blocked from this probability on.
BLOCK_FROM = 0.5

#: Families of words in the names of sites that a training corpus should not have, and ordinary words.
SPAM_FAMILIES = {
    "gambling": "poker bingo roulette jackpot lotto blackjack wager slots bookmaker",
    "pharmacy": "viagra cialis pharma meds drugs steroid dosage rx tablets",
    "dating": "porn sex sexy nude naked cams escort girls dating singles",
    "money": "loans payday credit forex crypto bitcoin debt cash profit income",
    "gifts": "prize bonus gift reward lucky lottery deals discount coupon",
    "malware": "hack crack keygen warez torrent cheat serial popup codec",
    "promotion": "seo backlinks affiliate banner click clicks likes followers promo traffic",
    "fakes": "replica fake luxury outlet rolex handbags wholesale clearance",
}
PLAIN_WORDS = """archive art atlas bakery band bank bird book bridge camp castle chess choir city club coast code coffee college
cook cycle daily data design doctor dance earth energy fair family field film fish fitness flower forest garden gazette
geo green guide harbor health herald hill history home hotel house island journal kitchen lab lake law leaf library light link
local maps market math media meteo mill mobile moon mountain museum music nature news north ocean office open opera orchard park
paper photo physics planet poem post press radio rail recipe review river road school science sea shop sky society soft song
south sport star stone story studio summer sun tea tech theatre thesis thread times tool tour town trade travel tree
union valley village voice walk water weather west wiki wind winter wood world writer yoga zoo""".split()
_FRONT, _TONGUES = ("", "www.", "m.", "blog."), ("en", "de", "fr", "es")
#: Ordinary sites are under these; spam is as often under one of the cheap ones.
_DOMAINS, _CHEAP = ("example.com", "example.org", "example.net", "example.edu"), ("example.top", "example.xyz", "example.biz", "example.click")
_ENDS = ("", "/", ".html", "?page=2&ref=x", "#top", "?utm_source=feed")
#: Of a hundred names of two words, how many have a hyphen: spam and ordinary ones.
HYPHENS = {1: 85, 0: 10}


def _pick(key: str, options):
    return options[int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big") % len(options)]


def _invented(key: str) -> str:
    """A name that is no word: syllables of a consonant or two, a vowel and sometimes a consonant."""
    letter = lambda k, of: _pick(f"{key}{k}", of)
    return "".join(letter(f"a{k}", "bcdfghklmnprstvwz") + letter(f"b{k}", ("", "", "h", "r", "l")) + letter(f"c{k}", "aeiou") + letter(f"d{k}", ("", "n", "r", "s")) for k in range(2 + len(key) % 2))


def labelled(without: str | None = None) -> list[tuple[str, int]]:
    """The labelled URL table: 1 for pages that a training corpus should not have. Traits of theirs are words of the
    families (all but `without`), names of two or three parts joined by hyphens, digits at a name's end, and cheap
    domains; ordinary names are words, pairs of them mostly without a hyphen, and invented names."""
    words = [w for family, text in SPAM_FAMILIES.items() if family != without for w in text.split()]
    out = {}
    for i in range(2400):
        spam = i % 7 < 2
        key = f"{'spam' if spam else 'plain'}:{i}"
        one = lambda k: _pick(key + k, words if spam and k != "y" else PLAIN_WORDS) if spam or i % 7 < 4 else _invented(key + k)  # noqa: B023, E731
        hyphen = "-" if int(hashlib.md5(f"{key}-".encode()).hexdigest(), 16) % 100 < HYPHENS[int(spam)] else ""
        if spam:  # a spam word with another one or with an ordinary one, on either side
            parts = [one("x"), _pick(key + "z", [one("y"), one("w")])]
            parts = parts[:: _pick(key + "turn", (1, -1))] + ([one("v")] if i % 5 == 0 else [])
            name = hyphen.join(parts) + (str(i % 900) if i % 4 == 0 else "")
        else:
            name = one("x") if i % 7 == 2 or i % 7 > 4 else hyphen.join((one("x"), one("w")))
        at = [_pick(f"{k}{i}", x) for k, x in enumerate((("http", "https"), _FRONT, _DOMAINS + _CHEAP if spam else _DOMAINS, _TONGUES, _ENDS))]
        out[name] = (f"{at[0]}://{at[1]}{name}.{at[2]}/{at[3]}/{i * 37 % 9973}{at[4]}", int(spam))
    return list(out.values())


def of_family(family: str, n: int = 200) -> list[str]:
    """URLs under ordinary domains whose names are two words of a family, to hold a model against that never saw it."""
    words = SPAM_FAMILIES[family].split()
    names = [_pick(f"{family}{i}a", words) + _pick(f"{family}{i}j", ("-", "-", "-", "")) + _pick(f"{family}{i}b", words) for i in range(n)]
    return [f"http://{name}.{_pick(f'{family}{i}d', _DOMAINS)}/en/{i * 37 % 9973}" for i, name in enumerate(names)]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    found = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, found, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is looked at first
        at, cut, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(cut + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def slots(host: Column, path: Column) -> Column:
    """The hashed n-grams of both parts, an array of slot numbers with repeats."""

    def grams(part: Column, mark: str, n: int) -> Column:
        text = F.concat(F.lit("^"), part, F.lit("$"))
        count = F.length(text) - (n - 1)
        starts = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        digest = lambda i: F.substring(F.md5(F.concat(F.lit(f"{mark}{n}:"), F.substring(text, i, F.lit(n)))), 1, 8)
        return F.transform(starts, lambda i: (F.conv(digest(i), 16, 10).cast("long") % SLOTS).cast("int"))

    none = F.array().cast("array<int>")
    return F.concat(*[F.when(part != "", grams(part, mark, n)).otherwise(none) for part, mark in ((host, "h"), (path, "p")) for n in SIZES])


def slots_of(url: str) -> list[int]:
    """The same for a URL of the labelled table."""
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    texts = [(mark, f"^{part}$") for mark, part in (("h", host.translate(ASCII_LOWER)), ("p", path)) if part]
    grams = [f"{mark}{n}:{text[i : i + n]}" for mark, text in texts for n in SIZES for i in range(len(text) - n + 1)]
    return [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % SLOTS for g in grams]


@lru_cache(maxsize=2)
def train(rows: tuple[tuple[str, int], ...] | None = None) -> tuple[tuple[float, ...], float]:
    """Weights by slot and the intercept, by gradient descent on the logistic loss of the labelled table."""
    table = rows or labelled()
    found = [slots_of(url) for url, _ in table]
    size = np.array([max(1, len(x)) for x in found])
    row, col = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.array([k for x in found for k in x], np.int64)
    value, label = 1 / np.sqrt(size)[row], np.array([y for _, y in table], np.float64)
    worth = np.where(label == 1, SPAM_WORTH, 1.0) / max(1, len(table))
    weights, bias, push, lean = np.zeros(SLOTS), 0.0, np.zeros(SLOTS), 0.0
    for _ in range(EPOCHS):
        z = bias + np.bincount(row, weights[col] * value, len(table))
        error = worth * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        push = MOMENTUM * push - RATE * (np.bincount(col, error[row] * value, SLOTS) + DECAY * weights)
        lean = MOMENTUM * lean - RATE * error.sum()
        weights, bias = weights + push, bias + lean
    grain = lambda w: round(w / GRAIN) * GRAIN
    return tuple(map(grain, weights.tolist())), grain(float(bias))


def probability(host: Column, path: Column, model: tuple[tuple[float, ...], float]) -> Column:
    weights, bias = model
    w = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")  # folded to a literal once
    found = slots(host, path)
    norm = F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))
    total = F.aggregate(found, F.lit(0.0), lambda a, k: a + F.get(w, k))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(bias) + total / norm)))


def judged(pages: DataFrame, model: tuple[tuple[float, ...], float] | None = None, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of block."""
    model = model or train()
    host, path = split_url(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    scored = cut.select("*", fitting_rule(h, p, rules).alias("rule"), probability(h, p, model).alias("p_block"))
    by_rule = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    blocked = (F.col("p_block") >= BLOCK_FROM) & ((h != "") | (p != ""))
    by_model = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.when(F.col("rule").isNull(), by_model).otherwise(F.try_element_at(by_rule, F.col("rule")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("p_block", 6).alias("p_block"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def oracle_sql() -> str:
    """The trained weights as a table; splitting, rules, n-grams and scores stated again."""
    weights, bias = train()
    known = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in enumerate(weights) if w)
    rules = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in RULES.items())
    marks = ", ".join(f"('{mark}', {n})" for mark in "hp" for n in SIZES)
    return f"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES {rules}) t(rule, site, prefix, verdict)),
fit AS (
  SELECT rid, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS ruled
  FROM u, rules WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix) GROUP BY rid),
w AS (SELECT * FROM (VALUES {known}) t(slot, weight)),
part AS (
  SELECT rid, mark, n, '^' || CASE mark WHEN 'h' THEN host ELSE path END || '$' AS t FROM u, (VALUES {marks}) m(mark, n)
  WHERE CASE mark WHEN 'h' THEN host ELSE path END <> ''),
gram AS (SELECT rid, mark || n || ':' || substr(t, i, n) AS g FROM (SELECT *, unnest(range(1, length(t) - n + 2)) AS i FROM part)),
slot AS (SELECT rid, ('0x' || substr(md5(g), 1, 8))::BIGINT % {SLOTS} AS slot FROM gram),
score AS (SELECT rid, coalesce(sum(weight), 0) / sqrt(count(*)) AS s FROM slot LEFT JOIN w USING (slot) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN s IS NOT NULL AND 1 / (1 + exp(-({bias!r} + s))) >= {BLOCK_FROM} THEN 'block' ELSE 'allow' END) AS verdict,
       round(1 / (1 + exp(-({bias!r}::DOUBLE + coalesce(s, 0)))), 6) AS p_block
FROM u LEFT JOIN fit USING (rid) LEFT JOIN score USING (rid)
"""
