"""Queries of several rounds: evidence loops, hops, clusters and names of entities, chains of parents, folds over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from millrace.operators import clusters, entities, graph, hops
from millrace.plans.catalog import ORACLES, TRIPLES_SQL, _triples, query
from millrace.plans.kit import Rows
from millrace.runtime import checkpoint_root, materialize, table
from millrace.sources.leaves import json_texts
from millrace.streaming import stateful

LOOPS, ENOUGH = 4, 12


def _corpus(name: str, rows: str) -> str:
    """CTEs with a corpus' terms; rows is a query of (id, text)."""
    return f"""{name}t AS (SELECT id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM ({rows})), {name}l AS (SELECT id, len(t) AS dl FROM {name}t), {name}s AS (SELECT count(*) AS n, avg(dl) AS av FROM {name}l),
  {name}f AS (SELECT id, x AS term, count(*) AS tf FROM (SELECT id, unnest(t) AS x FROM {name}t) GROUP BY 1, 2), {name}d AS (SELECT term, count(*) AS df FROM {name}f GROUP BY term)"""


def _leg(name: str, leg: int, i: int, k: int) -> str:
    score = "round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6)"
    return f"""SELECT query_id, {leg} AS leg, id, rank, left(text, 300) AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, f.id, {score} AS score FROM w{i} JOIN {name}f f USING (term) JOIN {name}d USING (term) JOIN {name}l l ON l.id = f.id, {name}s GROUP BY 1, 2)) JOIN {name}t USING (id) WHERE rank <= {k}"""


def _loop(i: int) -> str:
    earlier = " AND ".join(["true", *[f"NOT EXISTS (SELECT 1 FROM n{j} WHERE n{j}.query_id = a.query_id AND left(n{j}.text, 80) = left(a.text, 80))" for j in range(i)]])
    return f"""w{i} AS (SELECT query_id, x AS term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM q{i}) GROUP BY 1, 2),
  a{i} AS ({_leg("d", 0, i, 3)} UNION ALL {_leg("m", 1, i, 3)}),
  n{i} AS (SELECT * FROM a{i} a WHERE {earlier} QUALIFY row_number() OVER (PARTITION BY query_id, left(text, 80) ORDER BY leg, rank, id) = 1),
  h{i} AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS x FROM a{i}),
  g{i} AS (SELECT query_id, list_sort(list(DISTINCT x))[1:5] AS gap FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[a-z]{{4,}}')) AS x FROM q{i}) u WHERE NOT EXISTS (SELECT 1 FROM h{i} h WHERE h.query_id = u.query_id AND h.x = u.x) GROUP BY query_id),
  c{i} AS (SELECT query_id, count(*) AS found, string_agg(leg || ':' || id, ',' ORDER BY leg, rank, id) AS ids FROM n{i} GROUP BY query_id),
  r{i} AS (SELECT query_id, question, {i} AS hop, coalesce(found, 0) AS found, coverage + coalesce(found, 0) AS coverage, coalesce(gap, []) AS gap, coalesce(ids, '') AS ids FROM q{i} LEFT JOIN c{i} USING (query_id) LEFT JOIN g{i} USING (query_id)),
  q{i + 1} AS (SELECT query_id, question, question || ' ' || array_to_string(gap[1:3], ' ') AS text, coverage FROM r{i} WHERE coverage < {ENOUGH} AND len(gap) > 0)"""


EVIDENCE_SQL = f"""WITH {_corpus("d", "SELECT doc_id AS id, coalesce(text, '') AS text FROM documents")}, {_corpus("m", "SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS text FROM conversations")},
  q0 AS (SELECT item_id AS query_id, coalesce(text, '') AS question, coalesce(text, '') AS text, 0 AS coverage FROM benchmark),
  {", ".join(_loop(i) for i in range(LOOPS))}
  {" UNION ALL ".join(f"SELECT query_id, hop::INTEGER AS hop, found::BIGINT AS found, coverage::BIGINT AS coverage, array_to_string(gap, ',') AS gap, ids FROM r{i}" for i in range(LOOPS))}"""


@query(EVIDENCE_SQL)
def evidence_loops(spark, sf):
    """Evidence for every benchmark text from documents and conversation turns, in rounds that ask for what is lacking."""
    d = table(spark, sf, "documents").select(col("doc_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select((col("conv_id") * 1000 + col("turn")).alias("id"), "text")
    asked = table(spark, sf, "benchmark").select(col("item_id").alias("query_id"), "text")
    evidence, rounds = hops.evidence_loop(asked, [hops.text_leg(d, 3), hops.text_leg(turns, 3)], LOOPS, ENOUGH)
    listed = F.array_sort(F.collect_list(F.struct("leg", "rank", "id")))  # at most six rows of a round
    ids = evidence.groupBy("query_id", "hop").agg(F.array_join(F.transform(listed, lambda r: F.concat_ws(":", r["leg"], r["id"])), ",").alias("ids"))
    return rounds.join(ids, ["query_id", "hop"], "left").select("query_id", "hop", "found", "coverage", F.array_join("gap", ",").alias("gap"), F.coalesce("ids", F.lit("")).alias("ids"))


@query()
def hybrid_hops(spark, sf):
    """The five best documents of every benchmark text by words and hashed vectors, with more hops where the best is weak."""
    d = table(spark, sf, "documents").select(col("doc_id").alias("id"), "text")
    asked = table(spark, sf, "benchmark").select(col("item_id").alias("query_id"), "text")
    return hops.hop_search(asked, [hops.hybrid_leg(d, 15)], 5)


def _numbered(spark, sf):
    """Where customers, suppliers and nations are and which segment customers are in, numbered by the tables' keys."""
    nation = table(spark, sf, "nation")
    fact = lambda t, subject, relation, object_, key, n: t.select((col(key) * 4 + n).alias("ord"), subject.alias("subject"), F.lit(relation).alias("relation"), col(object_).alias("object"), (0.5 + (col(key) % 50) / 100.0).alias("confidence"))
    c = table(spark, sf, "customer").join(nation, col("c_nationkey") == col("n_nationkey"))
    s = table(spark, sf, "supplier").join(nation, col("s_nationkey") == col("n_nationkey"))
    r = nation.join(table(spark, sf, "region"), col("n_regionkey") == col("r_regionkey"))
    person = F.concat(F.lit("c"), "c_custkey")
    parts = [fact(c, person, "located_in", "n_name", "c_custkey", 0), fact(c, person, "in_segment", "c_mktsegment", "c_custkey", 1), fact(s, F.concat(F.lit("s"), "s_suppkey"), "located_in", "n_name", "s_suppkey", 2), fact(r, col("n_name"), "part_of", "r_name", "n_nationkey", 3)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query()
def entity_clusters(spark, sf):
    """Clusters of entities that share a fact, by the first named, with the clusters' relations."""
    t = materialize(_numbered(spark, sf), "triples")
    found = materialize(clusters.star_clusters(t), "clusters").hint("merge")
    named = clusters.cluster_relations(t, found).select("center", F.array_join("relations", ",").alias("relations"))
    return found.join(named, "center")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS depth FROM orders)
  SELECT id, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE depth END::BIGINT AS depth, o_custkey % 10 = 0 AS cyclic FROM o""")
def order_chains(spark, sf):
    """How many earlier orders of its customer an order has, by its parents; every tenth customer's first order follows the last, which is a circle."""
    by = W.partitionBy("o_custkey").orderBy("o_orderkey")
    last = F.last("o_orderkey").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    parent = F.coalesce(F.lag("o_orderkey").over(by), F.when(col("o_custkey") % 10 == 0, last))
    return graph.ancestors(table(spark, sf, "orders").select(col("o_orderkey").alias("id"), parent.alias("parent")))



ASKED = Rows(
    "asked",
    "id int, text string",
    ((1, "what do you know about c@ and Nation_3"), (2, "C1, c2; c3 c4 c5 c6 c7 in NATION 5"), (3, "nothing known here"), (4, "is s@ in region_1 or in region 2 or in nation_@"), (5, "c@ c@ c@ and s1"), (6, "nation_1 has suppliers, nation_0 too")),
).over("conversations", "t.conv_id * 31 + t.turn", id="t.conv_id * 1000 + t.turn", text="replace(p.text, '@', '' || (t.conv_id % 20 + 1)) || ' ' || t.text")


@query(f"""WITH {TRIPLES_SQL}, {ASKED.cte}, e AS (SELECT subject AS name, subject || ' ' || relation || ' ' || object AS fact, confidence, subject, relation, object FROM tr UNION ALL SELECT object, subject || ' ' || relation || ' ' || object, confidence, subject, relation, object FROM tr WHERE subject <> object),
  b AS (SELECT name, fact, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, subject, relation, object) AS rank FROM e QUALIFY rank <= 3), k AS (SELECT array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ' ') AS k, min(name) AS name FROM (SELECT DISTINCT name FROM b) GROUP BY 1),
  t AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM asked), g AS (SELECT id, at_, n, array_to_string(t[at_ + 1:at_ + n], ' ') AS k FROM (SELECT id, t, n, unnest(range(0, len(t) - n + 1)) AS at_ FROM t, (SELECT unnest(range(1, 5)) AS n))),
  m AS (SELECT id, name, min(at_) AS at_ FROM g JOIN k USING (k) GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY at_) AS nth FROM m QUALIFY nth <= 5),
  c AS (SELECT id, fact, row_number() OVER (PARTITION BY id ORDER BY nth, rank) AS place FROM f JOIN b USING (name) QUALIFY place <= 5)
  SELECT id, coalesce((SELECT string_agg(fact, '; ' ORDER BY place) FROM c WHERE c.id = asked.id), '') AS context FROM asked""")
def recall_context(spark, sf):
    """What the graph says about the entities that conversation turns name; here no name lies within another."""
    asked = materialize(ASKED.df(spark, sf), "asked")
    return entities.enrich(asked, _triples(spark, sf)).select("id", F.array_join("context", "; ").alias("context"))


ALIAS_SQL = """al AS (SELECT n_name AS alias, 'N' || (n_nationkey % 5) AS canonical FROM nation UNION ALL SELECT 'N' || j, 'G' || (j % 2) FROM (SELECT DISTINCT n_nationkey % 5 AS j FROM nation) UNION ALL SELECT r_name, 'R' || r_regionkey FROM region UNION ALL SELECT 'R' || r_regionkey, r_name FROM region),
  cn AS (SELECT n_name AS name, 'G' || (n_nationkey % 5 % 2) AS canonical FROM nation UNION ALL SELECT DISTINCT 'N' || (n_nationkey % 5), 'G' || (n_nationkey % 5 % 2) FROM nation UNION ALL SELECT r_name, least(r_name, 'R' || r_regionkey) FROM region UNION ALL SELECT 'R' || r_regionkey, least(r_name, 'R' || r_regionkey) FROM region)"""


def _aliases(spark, sf):
    """Nations under their group's name and groups under a larger one's; a region and its number are aliases of each other."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    five = (col("n_nationkey") % 5).cast("int")
    one = n.select(col("n_name").alias("alias"), F.concat(F.lit("N"), five).alias("canonical"))
    two = n.select(F.concat(F.lit("N"), five), F.concat(F.lit("G"), five % 2)).distinct()
    number = F.concat(F.lit("R"), col("r_regionkey"))
    return one.union(two).union(r.select("r_name", number)).union(r.select(number, "r_name"))


@query(f"WITH {TRIPLES_SQL}, {ALIAS_SQL} SELECT coalesce(s.canonical, subject) AS subject, relation, coalesce(o.canonical, object) AS object, max(confidence)::DOUBLE AS confidence FROM tr LEFT JOIN cn s ON s.name = subject LEFT JOIN cn o ON o.name = object GROUP BY 1, 2, 3")
def alias_merge(spark, sf):
    """Triples under canonical names, through aliases of aliases."""
    return entities.merge_aliases(_triples(spark, sf), _aliases(spark, sf))


@query(f"WITH {ALIAS_SQL} SELECT canonical, string_agg(name, ',' ORDER BY name) AS aliases FROM (SELECT DISTINCT * FROM cn WHERE name <> canonical) GROUP BY canonical")
def alias_names(spark, sf):
    """The other names of each entity."""
    return entities.alias_lists(_aliases(spark, sf)).select("canonical", F.array_join("aliases", ",").alias("aliases"))


def _streamed(spark, sf, fold):
    """What a stream of the events folds to: all of them, then, after a restart, a row a year later that lets the watermark pass them."""
    root = f"{checkpoint_root(spark)}/millrace/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{root}/in")
    stream = fold(spark.readStream.schema(events.schema).parquet(f"{root}/in"))
    stateful.drain(stream, f"{root}/out", f"{root}/checkpoint")
    end = events.agg((F.max("ts") + F.expr("interval 1 year")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), "ts")
    end.write.mode("append").parquet(f"{root}/in")
    stateful.drain(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/out").where("user_id <> -1")


@query(ORACLES["rate_limit_fold"])
def rate_limit_stream(spark, sf):
    """`rate_limit_fold` by a stateful stream, stopped and started again in between."""
    return _streamed(spark, sf, lambda e: stateful.stream_token_bucket(e, 2.0, late="5 minutes")).select(col("id").alias("event_id"), "allowed")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type, (least(abs(value), 100.0) / 200 + 0.5)::DOUBLE AS x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
  f AS (SELECT user_id, event_type, i, n, x AS c FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_type, o.i, o.n, round(least(1.0, f.c + (1 - f.c) * o.x * 0.5), 4) FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.i = f.i + 1)
  SELECT user_id, event_type, round(c, 2) AS confidence, n::BIGINT AS mentions FROM f WHERE i = n""")
def confidence_stream(spark, sf):
    """The confidence of what each user's events say, in the order of their times, by a stateful stream with a restart."""
    x = F.least(F.abs("value"), F.lit(100.0)) / 200 + 0.5
    out = _streamed(spark, sf, lambda e: stateful.stream_confidence(e, ["user_id", "event_type"], x, late="5 minutes"))
    return out.groupBy("user_id", "event_type").agg(F.round(F.max_by("confidence", "mentions"), 2).alias("confidence"), F.max("mentions").alias("mentions"))


@query("""SELECT conv_id AS id, sha256(string_agg(role || chr(10) || text, chr(10) ORDER BY turn) || CASE WHEN conv_id % 3 = 0 THEN chr(10) || 'end of ' || conv_id ELSE '' END) AS text FROM conversations GROUP BY conv_id UNION ALL SELECT -1 - event_id, sha256('') FROM events UNION ALL SELECT 1000000000 + page_id, sha256(url) FROM pages""")
def json_leaves(spark, sf):
    """The strings of nested documents: conversations with their turns, events' properties, pages; some have deeper levels."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(F.struct(t["role"].alias("role"), t["text"].alias("text")).alias("said"), t["turn"].alias("turn")))
    end = F.when(col("conv_id") % 3 == 0, F.struct(F.struct(F.array(F.array(F.concat(F.lit("end of "), "conv_id"))).alias("z")).alias("y")))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(col("conv_id").alias("id"), F.to_json(F.struct("turns", end.alias("x"))).alias("json"))
    c = c.withColumn("json", F.replace("json", F.lit('"x":'), F.lit('"z":')))  # after the turns, by alphabet
    e = table(spark, sf, "events").select((-1 - col("event_id")).alias("id"), col("props").alias("json"))
    p = table(spark, sf, "pages").select((1_000_000_000 + col("page_id")).alias("id"), F.to_json(F.struct("page_id", F.array(F.array("url")).alias("at"))).alias("json"))
    return json_texts(c.union(e).union(p)).select("id", F.sha2("text", 256).alias("text"))
