"""Mixing sources to target weights by hierarchical budgeting.

The token budget runs down a tree of domains, languages and sources. A node hands its budget to its children by
weight; what a child cannot take (its texts may be repeated only so often) goes to its siblings first and, once all
of them are full, back to the parent's siblings. A leaf fills its budget with whole epochs over its texts and the
token-prefix of one more epoch, in an order drawn by a seeded hash; the text at its end is taken if that comes nearer.
"""

from __future__ import annotations

import base64
from collections import defaultdict

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.llm.arrow import map_batches
from gleanery.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The domain of each known source; any other source is a domain of its own.
DOMAINS = {
    "annual_report": "filings",
    "proxy_statement": "filings",
    "sustainability_report": "filings",
    "earnings_call": "speech",
    "investor_podcast": "speech",
    "press_release": "company_news",
    "shareholder_mail": "company_news",
    "analyst_note": "third_party",
    "regulator_letter": "third_party",
    "web_forum": "web",
}


def load_tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Node:
    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.weight, self.room, self.given = 0.0, 0.0, 0.0


def pour(node: Node, amount: float) -> float:
    """Hands ``amount`` down; returns what found no room. Weights and room of inner nodes are sums over their leaves."""
    take = min(amount, node.room)
    node.given = take
    open_, left = {c for c in node.children.values() if c.room > 0}, take
    share: dict[Node, float] = defaultdict(float)
    while open_ and left > 1e-9:
        total = sum(c.weight for c in open_)
        parts = {c: left * (c.weight / total if total > 0 else 1 / len(open_)) for c in open_}
        full = {c for c in open_ if share[c] + parts[c] >= c.room}
        if not full:
            for c in open_:
                share[c] += parts[c]
            break
        for c in full:
            left -= c.room - share[c]
            share[c] = c.room
        open_ -= full
    for c in node.children.values():
        pour(c, share[c])
    return amount - take


def budgets(leaves: list[tuple[str, str, str, int]], weights: dict[str, tuple[float, int | None]], total: float, domains: dict[str, str]) -> dict[tuple[str, str, str], float]:
    """The budget of each leaf (domain, language, source), given its available tokens and each source's share and cap."""
    available: dict[str, int] = defaultdict(int)
    for _, _, s, n in leaves:
        available[s] += n
    root = Node()
    for source, (share, cap) in weights.items():
        # a share without texts stays with its domain, so that its siblings take it up first
        if not available[source] and share > 0:
            root.children.setdefault(domains.get(source, source), Node()).weight += share
    for d, lang, s, n in leaves:
        share, cap = weights[s]
        domain = root.children.setdefault(d, Node())
        language = domain.children.setdefault(lang, Node())
        leaf = language.children.setdefault(s, Node())
        leaf.weight = share * n / available[s] if available[s] else 0.0
        leaf.room = (total if cap is None else float(n) * cap) if share > 0 and n else 0.0
        for up in (root, domain, language):
            up.weight += leaf.weight
            up.room += leaf.room
    pour(root, total)
    return {(d, lang, s): root.children[d].children[lang].children[s].given for d, lang, s, _ in leaves}


def _key(c):
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def _counted(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``doc``, ``source``, ``lang``, 128-bit hash of the text and its tokens; null and blank texts are left out."""
    src = documents.select(F.col("doc_id").cast("long").alias("doc"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text").where(r"doc IS NOT NULL AND text IS NOT NULL AND text RLIKE '\\S'")

    def setup():
        encoding = load_tokenizer(tokenizer)

        def step(batch):
            texts = batch.column(3).to_pylist()
            sign = lambda x: x - (1 << 64) if x >> 63 else x
            h = [xxhash.xxh3_128_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
            return [batch.column(0), batch.column(1), batch.column(2), [sign(x >> 64) for x in h], [sign(x & (1 << 64) - 1) for x in h], [len(encoding.encode_ordinary(t)) for t in texts]]

        return step

    return map_batches(src, "doc long, source string, lang string, h1 long, h2 long, tokens long", setup)


def mix(documents: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 13, tokenizer: str = TOKENIZER, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``doc_id``, ``domain``, ``lang``, ``source``, ``tokens`` and ``copies`` (how often the text is used, 1 or more).
    Report, one row for each source of the weights or of the documents: ``source``, ``target_share``, ``max_repeats``,
    ``available_tokens`` (of distinct texts), ``mix_tokens``, ``reached_share``, ``mean_repeats``, ``most_repeats``.

    ``total_tokens`` is the size of the mix, by default the tokens of all distinct texts whose source has a weight.
    Spelling of a source (case, blanks, marks) does not count, nor does the region of a language; a null or unknown
    language is ``und``. Copies of a text are one text, that of its least ``doc_id``, and share its cap. Sources without
    a weight, null sources and blank texts are not drawn. A repeated source in the weights counts by the sum of its
    shares and its least cap. Where nothing can be drawn the mix is empty and shares are null.
    """
    domains = DOMAINS if domains is None else domains
    wanted = weights.where("source IS NOT NULL").groupBy(_key(F.col("source")).alias("key")).agg(F.min("source").alias("name"), F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.min("max_repeats").alias("cap"))
    table = {r["key"]: (r["name"], float(r["share"]), r["cap"]) for r in wanted.collect()}  # one row a source
    names = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[0]))]) if table else F.create_map().cast("map<string,string>")

    counted = _counted(documents, tokenizer)
    lang = F.lower(F.regexp_extract(F.trim(F.coalesce("lang", F.lit(""))), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    known = counted.select("doc", "h1", "h2", "tokens", F.try_element_at(names, _key(F.col("source"))).alias("source"), F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim("source")), r"[\s\-_]+", "_"), F.lit("")), F.lit("unknown")).alias("other"), F.when(lang == "", "und").otherwise(lang).alias("lang"))
    texts = known.groupBy("h1", "h2").agg(F.min(F.struct(F.col("source").isNull(), "doc", "source", "other", "lang", "tokens")).alias("t")).select("h1", "h2", "t.doc", "t.source", "t.other", "t.lang", "t.tokens")
    texts = cut(texts)
    drawn = texts.where("source IS NOT NULL AND tokens > 0")
    leaf_rows = drawn.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts")).collect()  # sources x languages
    shares = {name: (share, cap) for name, share, cap in table.values()}
    leaves = [(domains.get(r["source"], r["source"]), r["lang"], r["source"], int(r["tokens"])) for r in leaf_rows]
    total = float(total_tokens if total_tokens is not None else sum(n for *_, n in leaves))
    budget = budgets(leaves, shares, total, domains)
    spark = documents.sparkSession
    plan = [(d, lang_, s, int(budget[d, lang_, s] // n), int(budget[d, lang_, s] % n)) for d, lang_, s, n in leaves if n]
    leaf_plan = spark.createDataFrame(plan, "domain string, lang string, source string, epochs int, rest long")

    # the prefix of the last epoch: sums of hash ranges first, then the one range in which it ends
    ranges = max(1024, sum(int(r["texts"]) for r in leaf_rows) // 20_000)
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("h1"), F.col("h2"))
    placed = drawn.join(F.broadcast(leaf_plan), ["lang", "source"]).withColumn("order", order).withColumn("range", (F.shiftrightunsigned("order", 33) * ranges / F.lit(float(1 << 31))).cast("int"))
    by_leaf = W.partitionBy("lang", "source").orderBy("range")
    sums = placed.groupBy("lang", "source", "range", "rest").agg(F.sum("tokens").alias("n")).withColumn("upto", F.sum("n").over(by_leaf))
    inner = sums.select("lang", "source", "range", (F.col("upto") - F.col("n")).alias("before"), F.when(F.col("upto") <= F.col("rest"), "all").when(F.col("upto") - F.col("n") < F.col("rest"), "part").otherwise("none").alias("takes"))
    joined = placed.join(inner, ["lang", "source", "range"])
    within = W.partitionBy("lang", "source", "range").orderBy(F.shiftrightunsigned("order", 1), "h1", "h2").rowsBetween(W.unboundedPreceding, 0)
    part = joined.where("takes = 'part'").withColumn("extra", (F.col("before") + F.sum("tokens").over(within) - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    whole = joined.where("takes <> 'part'").withColumn("extra", (F.col("takes") == "all").cast("int"))
    mixed = part.unionByName(whole).select(F.col("doc").alias("doc_id"), "domain", "lang", "source", "tokens", (F.col("epochs") + F.col("extra")).alias("copies")).where("copies > 0")
    mixed = cut(mixed)

    targets = spark.createDataFrame([(n, s, c) for n, (s, c) in shares.items()], "source string, target_share double, max_repeats int")
    have = texts.groupBy(F.coalesce("source", "other").alias("source")).agg(F.sum("tokens").alias("available_tokens"))
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_repeats"))
    report = targets.join(have, "source", "full").join(got, "source", "left")
    mix_tokens = F.coalesce("mix_tokens", F.lit(0)).cast("long")
    every = W.partitionBy(F.lit(1))  # one row a source
    report = report.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", F.coalesce("available_tokens", F.lit(0)).cast("long").alias("available_tokens"), mix_tokens.alias("mix_tokens"), F.try_divide(mix_tokens, F.sum(mix_tokens).over(every)).alias("reached_share"), F.try_divide(mix_tokens, F.col("available_tokens")).alias("mean_repeats"), F.coalesce("most_repeats", F.lit(0)).cast("int").alias("most_repeats"))
    return mixed, report
