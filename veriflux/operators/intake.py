"""Adapters from public sources to source signals, and text extraction from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, contains_any, stable_id, strip_tags

# Words that mark an insight.
INSIGHT_WORDS = ["incident", "harm", "risk", "fraud", "scam", "severity", "intentionally"]
SENTENCE_WORDS = ["reported incidents", "harm", "risk", "fraud", "scams", "intentionally caused"]
FINAL, HARM = ["governance", "final_output"], ["incident_taxonomy", "real_world_harm"]
SOURCES = {
    "arxiv": {
        "source_tier": 1, "source_type": "research", "source_name": "arXiv", "evidence_status": "unverified", "novelty": 3, "actionability": 3, "source_reliability": 4, "raw_detail_policy": "summarize_only",
        "risk_hypothesis": "This research result may describe an agentic AI risk, guardrail gap, or evaluation method worth translating into a safe probe.",
        "safe_reproduction": "Use paper abstractions and synthetic fixtures; do not copy operational exploit strings.",
    },
    "lookup": {
        "source_tier": 2, "source_type": "incident_database", "source_name": "AI Incident Database lookupbyurl", "novelty": 3, "source_reliability": 4, "raw_detail_policy": "safe_to_store", "affected_surfaces": FINAL, "risk_categories": [*HARM, "severity_mapping"],
        "risk_hypothesis": "Incident-linked public reports can reveal real-world harms that should broaden the probe backlog beyond security-only failure modes.",
        "description": "If the URL maps to an incident, abstract the harm pathway into one or more safe agentic-risk probes.", "expected_detection_stage": "governance",
        "safe_reproduction": "Use incident category summaries and synthetic placeholders rather than recreating harmful details.",
    },
    "snapshot": {
        "source_tier": 2, "source_type": "incident_database", "source_name": "AI Incident Database snapshot", "evidence_status": "corroborated", "novelty": 3, "actionability": 3, "source_reliability": 4, "raw_detail_policy": "summarize_only", "affected_surfaces": FINAL, "risk_categories": [*HARM, "severity_mapping"],
        "risk_hypothesis": "This incident suggests a real-world harm pathway that may require an agentic-risk taxonomy cell or probe.",
        "description": "Map the incident harm pathway to affected agentic surfaces and create a safe synthetic reproduction.", "expected_detection_stage": "governance",
        "safe_reproduction": "Use only high-level incident summary and category labels.", "notes": "Generated from AIID-style snapshot input.",
    },
    "insight": {
        "source_tier": 2, "source_type": "incident_database", "source_name": "MIT AI Incident Tracker", "evidence_status": "corroborated", "novelty": 3, "actionability": 3, "source_reliability": 4, "raw_detail_policy": "safe_to_store", "affected_surfaces": FINAL, "risk_categories": [*HARM, "public_salience"],
        "risk_hypothesis": "Incident trends can identify publicly salient harm categories that should be mapped to agentic surfaces and safe probes.",
        "description": "Translate the trend into a taxonomy-gap question and identify whether the current probe set covers the harm pathway.", "expected_detection_stage": "governance",
        "safe_reproduction": "Use trend-level categories and synthetic probes rather than reproducing incident details.", "notes": "Generated from MIT AI Incident Tracker trend page; treat LLM-classified trends as indicative.",
    },
    "post": {
        "source_tier": 3, "source_type": "social", "source_name": "X saved payload", "evidence_status": "unverified", "novelty": 4, "actionability": 3, "source_reliability": 2, "raw_detail_policy": "do_not_reproduce", "affected_surfaces": ["ingress", "final_output"], "risk_categories": ["jailbreak_motif", "guardrail_gap"],
        "risk_hypothesis": "This public X post may describe a jailbreak motif, agent failure, guardrail gap, or socially salient risk worth abstracting into a safe probe.",
        "description": "Human-review the post, abstract the failure pattern, and create a harmless probe without reproducing exploit text.", "expected_detection_stage": "ingress",
        "safe_reproduction": "Use benign placeholders and avoid copying jailbreak strings or operational misuse instructions.", "notes": "Generated from X API; review required before promotion.",
    },
    "curated": {
        "source_tier": 3, "source_type": "social", "source_name": "Curated social/web stream", "evidence_status": "unverified", "raw_detail_policy": "do_not_reproduce",
        "risk_hypothesis": "This public weak signal may imply a candidate agentic-risk pattern.",
        "description": "Create a harmless probe for the abstracted pattern.", "expected_detection_stage": "ingress",
        "safe_reproduction": "Use benign placeholders and do not reproduce raw exploit details.", "notes": "Generated from review-gated manual/social intake.",
    },
}
# End of fixed values.
#: Words of a bitmap of hashes; items of one or two words that go to every document as one array.
BITMAP, TINY = 1 << 12, 10_000
CLEANED = ["title", "source_name", "summary", "risk_hypothesis", "description", "safe_reproduction", "notes"]
FIELDS = ["signal_id", "title", "source_tier", "source_type", "source_name", "source_url", "observed_at", "summary", "risk_hypothesis", "affected_surfaces", "risk_categories", "evidence_status", "novelty", "actionability", "source_reliability", "raw_detail_policy", "proposed_probe", "notes"]
PROBE = ["probe_id", "description", "expected_detection_stage", "safe_reproduction"]


def source_signal(source: str, **given: Column) -> list[Column]:
    """The 18 fields of a signal: what is given, else the source's own words; texts are cleaned."""
    literal = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)
    values = {**{k: literal(v) for k, v in SOURCES[source].items()}, **given}
    values = {"notes": F.lit(""), **values}
    values = {k: clean(v) if k in CLEANED else v for k, v in values.items()}
    values["proposed_probe"] = F.struct(*[values[k].alias(k) for k in PROBE])
    return [values[k].alias(k) for k in FIELDS]


def others(df: DataFrame, *used: str) -> list[str]:
    """The columns that go along with a record's signal."""
    return [c for c in df.columns if c not in used and c not in FIELDS]


def first_of(*cs: Column) -> Column:
    """The first value that is neither null nor empty; null without any."""
    return F.coalesce(F.lit(None).cast("string"), *[F.nullif(c.cast("string"), F.lit("")) for c in cs])


def insights(html: Column, words: list[str] = INSIGHT_WORDS, k: int = 8) -> Column:
    """The first k list items that hold one of the words; what follows `Insights:` where that occurs."""
    items = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), strip_tags)
    body = F.transform(items, lambda x: clean(F.regexp_replace(F.regexp_replace(x, r"(?s)^.*?Insights:", ""), r"^[ \]]+|[ \]]+$", "")))
    return F.slice(F.filter(body, lambda x: (x != "") & contains_any(F.lower(x), words)), 1, k)


def insight_sentences(html: Column, words: list[str] = SENTENCE_WORDS, k: int = 8) -> Column:
    """For pages without such items: the first k sentences that hold one of the words."""
    return F.slice(F.filter(F.split(strip_tags(html), r"(?<=[.!?])\s+"), lambda s: contains_any(F.lower(s), words)), 1, k)


def page_insights(html: Column) -> Column:
    """List items, else sentences, each chosen by its own words."""
    return F.transform(F.array(insights(html)), lambda items: F.when(F.size(items) > 0, items).otherwise(insight_sentences(html)))[0]


def insight_signals(pages: DataFrame, as_of: str) -> DataFrame:
    """A signal for each insight of pages(url, html), with the pages' other columns."""
    rest = others(pages, "url", "html")
    found = pages.select("url", *rest, F.posexplode(page_insights(F.col("html"))).alias("i", "insight"))
    at, insight = (F.col("i") + 1).cast("string"), F.col("insight")
    return found.select(*rest, *source_signal(
        "insight", signal_id=stable_id("SIG-MIT", at, insight), probe_id=stable_id("PROBE-MIT", at, insight), title=F.concat(F.lit("MIT AI Incident Tracker insight "), at), source_url=F.col("url"), observed_at=F.lit(as_of), summary=insight,
    ))


def bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """One row with `bits`: BITMAP words of 64 bits, in which each hash of the column has one."""
    word, bit = F.pmod(F.shiftright(column, 6), F.lit(BITMAP)), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")
    held = hashes.groupBy(word.alias("id")).agg(F.bit_or(bit).alias("bits"))  # BITMAP rows at most
    every = hashes.sparkSession.range(BITMAP).join(held, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def held(bits: str, h: Column) -> Column:
    """Whether a hash's bit is set; other hashes may share it."""
    word = F.get(F.col(bits), F.pmod(F.shiftright(h, 6), F.lit(BITMAP)).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))) != 0


def verbatim(items: DataFrame, docs: DataFrame, words: int = 6) -> DataFrame:
    """(item_id, doc_id) where a document holds an item's trimmed text.

    Both sides meet on runs of `words` words: an item offers its first inner
    run, a document those of its own that may be one, by a bitmap of the items'.
    Shorter items meet documents on their longest inner word, likewise; those of
    one or two words have none, and are looked for in every document: by one array
    of all of them as long as there are at most TINY, else by a join.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    run = lambda h, at: F.xxhash64(F.slice(h, at, words))
    longest = lambda x, y: F.when(F.length(x) != F.length(y), F.length(x) - F.length(y)).when(x < y, -1).when(x > y, 1).otherwise(0)
    body = F.lower(F.trim("text"))
    i = items.select("item_id", body.alias("item"), split(body).alias("w"))
    # the outer words of an item may touch other letters in a document; of an item of a few words the longest inner one stands whole in it
    long = i.where(F.size("w") >= words + 2).select("item_id", "item", run(hashed("w"), 2).alias("key"))
    inner = F.slice("w", 2, F.size("w") - 2)
    some = i.where(F.size("w").between(3, words + 1)).select("item_id", "item", F.xxhash64(F.element_at(F.array_sort(inner, longest), -1)).alias("key"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("h") - words + 1, F.lit(1))), lambda k: run(F.col("h"), k))
    d = docs.select("doc_id", F.lower("text").alias("body")).withColumn("h", hashed(split(F.col("body"))))
    d = d.crossJoin(F.broadcast(bitmap(long, "key").withColumnRenamed("bits", "run_bits"))).crossJoin(F.broadcast(bitmap(some, "key").withColumnRenamed("bits", "word_bits")))  # a row of fixed size each
    keys = lambda found, bits, of: F.transform(F.array_distinct(F.filter(found, lambda h: held(bits, h))), lambda h: F.struct(F.lit(of).alias("of"), h.alias("key")))
    met = d.select("doc_id", F.explode(F.concat(keys(runs, "run_bits", 0), keys(F.col("h"), "word_bits", 1))).alias("k")).select("doc_id", "k.of", "k.key")
    wanted = long.withColumn("of", F.lit(0)).union(some.withColumn("of", F.lit(1)))
    near = met.join(wanted.select("of", "key", "item_id"), ["of", "key"]).select("item_id", "doc_id").distinct()
    bodies = docs.select("doc_id", F.lower("text").alias("body"))
    hit = near.join(wanted.select("item_id", "item"), "item_id").join(bodies, "doc_id").where(F.contains("body", F.col("item"))).select("item_id", "doc_id")
    # an item of one or two words may stand inside longer words: nothing but looking helps
    tiny = i.where(F.size("w") < 3).select("item_id", "item")
    if tiny.count() > TINY:
        return hit.union(bodies.join(tiny, F.contains("body", F.col("item"))).select("item_id", "doc_id"))
    listed = bodies.crossJoin(F.broadcast(tiny.agg(F.collect_list(F.struct("item_id", "item")).alias("tiny"))))  # one row of TINY items at most
    found = F.filter("tiny", lambda x: F.contains(F.col("body"), x["item"]))
    return hit.union(listed.select(F.explode(found).alias("t"), "doc_id").select("t.item_id", "doc_id"))


def posts(items: DataFrame, users: DataFrame, as_of: str, source_name: str | None = None, risk_categories: list[str] | None = None, affected_surfaces: list[str] | None = None, raw_detail_policy: str | None = None) -> DataFrame:
    """A signal for each post of items(event_id, author_id, text, created_at), with the address of its author, where known, and a short summary."""
    text, told = clean(F.col("text")), {}
    for k, v in (("source_name", source_name), ("raw_detail_policy", raw_detail_policy)):
        told |= {k: F.lit(v)} if v else {}
    for k, v in (("risk_categories", risk_categories), ("affected_surfaces", affected_surfaces)):
        told |= {k: F.array(*map(F.lit, v))} if v else {}
    j = items.join(users.select("author_id", "username"), "author_id", "left")
    url = F.when(F.col("username").isNotNull(), F.concat(F.lit("https://x.com/"), "username", F.lit("/status/"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("https://x.com/i/web/status/"), F.col("event_id").cast("string")))
    short = F.when(F.length(text) <= 220, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, 217)), F.lit("...")))
    raw, day = F.coalesce(F.col("text").cast("string"), F.lit("")), F.substring(F.coalesce(F.col("created_at").cast("string"), F.lit(as_of)), 1, 10)
    author = F.coalesce(F.concat(F.lit("@"), "username"), F.lit("X post"))
    return j.select(*others(items, "author_id", "text", "created_at"), *source_signal(
        "post", signal_id=stable_id("SIG-X", url, raw), probe_id=stable_id("PROBE-X", url, raw), title=F.concat(F.lit("X weak signal from "), author), source_url=url, observed_at=day, summary=short, **told,
    ))


def split_list(value: Column, default: str) -> Column:
    return F.filter(F.transform(F.split(first_of(value, F.lit(default)), ","), lambda x: F.trim(x)), lambda x: x != "")


def curated(records: DataFrame, as_of: str) -> DataFrame:
    """Signals of hand-curated records; what is missing is filled in, for review."""
    have = set(records.columns)
    get = lambda name, *default: first_of(*([F.col(name)] if name in have else []), *map(F.lit, default))
    number = lambda name, default: F.when(F.coalesce(F.col(name).try_cast("int"), F.lit(0)) != 0, F.col(name).try_cast("int")).otherwise(default) if name in have else F.lit(default)
    lists = lambda name, default: split_list(F.col(name), default) if name in have else F.split(F.lit(default), ",")
    url, title = first_of(*[F.col(c) for c in ("source_url", "url") if c in have], F.lit("manual-curation")), get("title", "Curated social/web weak signal")
    own = {k: get(name, SOURCES["curated"][k]) for k, name in (("source_name", "source_name"), ("risk_hypothesis", "risk_hypothesis"), ("evidence_status", "evidence_status"), ("raw_detail_policy", "raw_detail_policy"), ("description", "safe_probe_description"), ("expected_detection_stage", "expected_detection_stage"), ("safe_reproduction", "safe_reproduction"), ("notes", "notes"))}
    return records.select(*others(records, "url", "safe_probe_description", "expected_detection_stage", "safe_reproduction"), *source_signal(
        "curated", signal_id=stable_id("SIG-SOCIAL", url, title), probe_id=stable_id("PROBE-SOCIAL", url, title), title=title, source_url=url, observed_at=F.substring(get("observed_at", as_of), 1, 10),
        summary=get("summary", "Manual weak signal requiring review."), affected_surfaces=lists("affected_surfaces", "ingress,final_output"), risk_categories=lists("risk_categories", "jailbreak_motif"),
        novelty=number("novelty", 4), actionability=number("actionability", 3), source_reliability=number("source_reliability", 2), **own,
    ))


def incident_lookups(urls: DataFrame, incidents: DataFrame, as_of: str) -> DataFrame:
    """A signal for each of urls(url, and title and observed_at if there), by how many known incidents it has."""
    hits = incidents.groupBy("url").agg(F.count("*").alias("result_count"))
    return lookup_signals(urls.join(hits, "url", "left").withColumn("result_count", F.coalesce("result_count", F.lit(0))), as_of)


def lookup_signals(found: DataFrame, as_of: str) -> DataFrame:
    """A signal for each of found(url, result_count, and title and observed_at if there)."""
    have, url, n = set(found.columns), F.col("url"), F.col("result_count")
    get = lambda name, default: first_of(F.col(name), default) if name in have else default
    return found.select(*others(found), *source_signal(
        "lookup", signal_id=stable_id("SIG-AIID", url), probe_id=stable_id("PROBE-AIID", url), title=get("title", F.concat(F.lit("AIID lookup for "), url)), source_url=url, observed_at=get("observed_at", F.lit(as_of)),
        summary=F.concat(F.lit("AIID lookup returned "), n.cast("string"), F.lit(" matching result(s) for the source URL.")), evidence_status=F.when(n > 0, "corroborated").otherwise("unverified"), actionability=F.when(n > 0, 3).otherwise(2), notes=F.concat(F.lit("lookup_result_count="), n.cast("string")),
    ))


def incident_snapshot(items: DataFrame, as_of: str) -> DataFrame:
    """Signals of incident records whose fields go by several names."""
    names = set(items.columns)
    pick = lambda *cs: first_of(*[clean(F.col(c)) for c in cs if c in names])
    key = pick("incident_id", "id", "number", "url")
    title = F.coalesce(pick("title", "name", "description"), F.concat(F.lit("AI incident "), F.coalesce(key, F.lit(""))))
    return items.select(*others(items, "url", "date", "name", "id", "incident_id", "number", "description", "report_url", "text"), *source_signal(
        "snapshot", signal_id=stable_id("SIG-AIID", key, title), probe_id=stable_id("PROBE-AIID", key, title), title=title, source_url=F.coalesce(pick("url", "source_url", "report_url"), F.lit("manual-snapshot")),
        observed_at=F.substring(F.coalesce(pick("date", "observed_at"), F.lit(as_of)), 1, 10), summary=F.substring(F.coalesce(pick("summary", "description", "text"), title), 1, 900),
    ))


def snapshot_items(payload: DataFrame) -> DataFrame:
    """The records of a payload that keeps them under incidents, reports, results or data."""
    keys = [c for c in ("incidents", "reports", "results", "data") if c in payload.columns]
    return payload.select(F.explode(F.coalesce(*[F.col(k) for k in keys])).alias("item")).select("item.*")


def feed_entries(feed: DataFrame) -> DataFrame:
    """Fields of Atom entries held one to a row in `entry`; the alternate link, else the first."""
    text = lambda tag: clean(F.expr(f"xpath_string(entry, 'entry/{tag}')"))
    link = F.coalesce(F.try_element_at(F.expr("""xpath(entry, 'entry/link[@rel="alternate"]/@href')"""), F.lit(1)), F.try_element_at(F.expr("xpath(entry, 'entry/link/@href')"), F.lit(1)), F.lit(""))
    return feed.select("*", text("id").alias("entry_id"), text("title").alias("title"), text("summary").alias("summary"), F.substring(text("published"), 1, 10).alias("published"), F.substring(text("updated"), 1, 10).alias("updated"), link.alias("link")).drop("entry")


def feed_signals(entries: DataFrame, config: DataFrame, as_of: str) -> DataFrame:
    """A signal for each entry and query; queries are a configuration file, a handful of rows."""
    q = config.select(F.col("name").alias("query_name"), F.col("affected_surfaces").alias("q_surfaces"), F.col("risk_categories").alias("q_categories"), F.col("proposed_probe_stage").alias("q_stage"), F.col("query").alias("q_text"))
    j = entries.crossJoin(F.broadcast(q))  # a configuration file
    url, day = first_of(F.col("link"), F.col("entry_id")), first_of(F.col("updated"), F.lit(as_of))
    return j.select(*others(entries, "entry_id", "published", "updated", "link"), "query_name", *source_signal(
        "arxiv", signal_id=stable_id("SIG-ARXIV", F.col("query_name"), url), probe_id=stable_id("PROBE-ARXIV", F.col("query_name"), url), title=F.col("title"), source_url=url, observed_at=day, summary=F.substring("summary", 1, 900),
        affected_surfaces=F.col("q_surfaces"), risk_categories=F.col("q_categories"), expected_detection_stage=F.col("q_stage"),
        description=F.concat(F.lit("Review the paper and convert any safe, relevant finding into a probe for "), "query_name", F.lit(".")), notes=F.concat(F.lit("Generated from arXiv query: "), F.coalesce("q_text", F.lit(""))),
    ))
