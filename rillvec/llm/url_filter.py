"""URL filters by rules and by link-graph propagation, with DataFrame functions only.

Rules speak first: a rule fits its host and all subdomains where the path
starts with the rule's path, and the longest rule wins.  Pages that no rule
fits are judged by their host.

Hosts form a graph: hyperlinks between hosts, and ties between a host and the
domains above it, up to the registrable one: hosts under a suffix that anyone
can register below (``SUFFIXES``) have nothing to do with each other.  Trust is personalised PageRank along the edges from the
hosts of pages that rules allow; distrust is the same along reversed edges
from the hosts of pages that rules block.  A host is blocked if its distrust
is above its trust and above ``LEVEL`` times the mean over hosts.  What a host
without outgoing edges holds goes back to the seeds; at the fixed point that
only scales all ranks by one number, so ranks are divided by their sum.

Edges are aggregated per pair of hosts before anything is joined.  Ranks are
cut from their lineage every few steps, and steps go on until they settle: until
the summed change of trust and distrust over ``CUT`` steps is at most
``TOLERANCE`` of the mean share of a host (1 / hosts).  All later steps together
can change them by less than that again.

Edge cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null html has no links; repeated rows come out as
often as they came in; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import durable, pinned

# Fixed values: (verdict, rule) of the query.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING = 0.85
#: Steps that the SQL unrolls; the operator itself goes on until ranks settle.
STEPS = 10
CUT = 5
TOLERANCE = 1e-3
LEVEL = 1.0
# Suffixes of two labels below which names are registered; others have one label.
SUFFIXES: tuple[str, ...] = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn",
    "edu.au", "edu.cn", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk",
    "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "tumblr.com", "vercel.app", "weebly.com", "wixsite.com", "wordpress.com",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls if none does."""
    found, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found, said = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(verdict)).otherwise(said)
    return found, said


def edges_of(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, and ties of hosts to the domains above them, from the registrable one on."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?([a-z]*:?//[^"'\s>]+)"""), F.lit(1))
    linked = pages.where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(links).alias("link"))
    linked = linked.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("dst"))
    hosts = pages.select("host").distinct()
    labels = F.split("host", r"\.")
    least = F.when(F.array_join(F.slice(labels, -2, 2), ".").isin(*SUFFIXES), 3).otherwise(2)
    above = F.transform(F.sequence(least, F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    chain = hosts.where(F.size(labels) > least).select(above.alias("chain")).select(F.explode(F.arrays_zip(F.slice("chain", 1, F.size("chain") - 1).alias("up"), F.slice("chain", 2, F.size("chain")).alias("down"))).alias("tie"))
    ties = chain.select(F.explode(F.array(F.struct(F.col("tie")["up"].alias("src"), F.col("tie")["down"].alias("dst")), F.struct(F.col("tie")["down"].alias("src"), F.col("tie")["up"].alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()
    every = linked.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight")).unionByName(ties.withColumn("weight", F.lit(1).cast("long")))
    return every.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int | None = None, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust of all hosts reached, settled or after ``steps``; ``seeds`` has host, good, bad (numbers of pages)."""
    mass = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    good, bad = max(1, mass["g"] or 0), max(1, mass["b"] or 0)
    start = durable(seeds.select("host", (F.col("good") / good).alias("trust0"), (F.col("bad") / bad).alias("distrust0")), "url-seeds")
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    into = edges.groupBy(F.col("dst").alias("d")).agg(F.sum("weight").alias("into"))
    # One row for each direction: trust goes from src to dst, distrust from dst to src.
    shares = edges.join(out, "src").join(into, edges["dst"] == into["d"]).select("src", "dst", (F.col("weight") / F.col("out")).alias("forth"), (F.col("weight") / F.col("into")).alias("back"))
    ways = durable(shares.select("src", "dst", F.col("forth").alias("forth"), F.lit(0.0).alias("back")).unionByName(shares.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("forth"), "back")).groupBy("src", "dst").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back")), "url-ways")
    rank = start.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    settled, step = rank, 0
    while steps is None or step < steps:
        step += 1
        sent = ways.join(rank, ways["src"] == rank["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("forth") * F.col("trust")).alias("t"), F.sum(F.col("back") * F.col("distrust")).alias("b"))
        rank = start.join(sent, "host", "full_outer").select("host", ((1 - damping) * zero("trust0") + damping * zero("t")).alias("trust"), ((1 - damping) * zero("distrust0") + damping * zero("b")).alias("distrust"))
        if step % CUT and step != steps:
            continue
        rank = durable(rank, "url-rank")
        if steps is None:
            before = settled.select("host", F.col("trust").alias("trust1"), F.col("distrust").alias("distrust1"))
            change = rank.join(before, "host", "full_outer").agg(F.sum(F.abs(zero("trust") - zero("trust1")) + F.abs(zero("distrust") - zero("distrust1"))).alias("moved"), F.count("*").alias("hosts")).first()
            if (change["moved"] or 0.0) * max(1, change["hosts"]) <= TOLERANCE:
                break
            settled = rank
    total = rank.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("b")).first()
    return rank.select("host", (F.col("trust") / (total["t"] or 1.0)).alias("trust"), (F.col("distrust") / (total["b"] or 1.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, steps: int | None = None, level: float = LEVEL) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    rows = pinned(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("said", said)
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"))
    rank = propagate(durable(edges_of(rows), "url-edges"), seeds, steps)
    mean = rank.agg(F.avg("distrust")).first()[0] or 0.0
    bad = rank.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") > level * mean)).select("host", F.lit("block").alias("judged"))
    return ruled.drop("html", "url").join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", "judged", F.lit("allow")).alias("verdict"))
