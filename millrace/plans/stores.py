"""Queries: goals, memories, the knowledge graph, feedback exports, retrieval parts, review queues and shards."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import checks as K
from millrace.functions import text as X
from millrace.operators import graph, memory, planning, similarity, summaries
from millrace.plans.catalog import MEM_STOP, TRIPLES_SQL, _triples, query
from millrace.plans.checking import MESSAGES, sql_cases
from millrace.plans.cleaning import sql_replaced, sql_words
from millrace.plans.kit import Rows, literal
from millrace.runtime import materialize, table

col = F.col

# --- goals ---

GOALS = Rows(
    "goals",
    "goal_id string, title string, status string, priority int, created_at double, parent string",
    (
        ("g1", "Ship the report", "active", 2, 10.0, None), ("g2", "Write the draft", "active", 5, 11.0, "g1"), ("g3", "Rest", "paused", 9, 1.0, None), ("g4", "Find sources", "active", 1, 2.0, "g3"), ("g5", "Old work", "completed", 0, 0.5, None),
        ("g6", "Follow up", "active", 7, 3.0, "g5"), ("g7", "Lost child", "active", 3, 4.0, "gone"), ("c1", "Circle one", "active", 8, 5.0, "c2"), ("c2", "Circle two", "paused", 8, 6.0, "c1"), ("c3", "Hangs on circle", "completed", 1, 7.0, "c1"), ("g8", "Report", "paused", 1, 8.0, None),
    ),
).over("supplier", "t.s_suppkey", True, goal_id="p.goal_id || '-' || t.s_suppkey", parent="p.parent || '-' || t.s_suppkey", owner="t.s_suppkey")
TURNS = Rows("turns", "m int, message string", ((1, "work on g2 please"), (2, "let us ship the report!"), (3, "just go on"), (4, "circle ONE now"), (5, "the report"), (6, "g3 or g6"), (7, ""))).over("supplier", "t.s_suppkey", True, m="t.s_suppkey * 10 + p.m", message="replace(replace(replace(p.message, 'g2', 'g2' || '-' || t.s_suppkey), 'g3', 'g3' || '-' || t.s_suppkey), 'g6', 'g6' || '-' || t.s_suppkey)", owner="t.s_suppkey")
GOALS_SQL = f"""{GOALS.cte}, walk(goal_id, here, path, hit) AS (SELECT goal_id, parent, [goal_id], false FROM goals UNION ALL SELECT w.goal_id, g.parent, list_append(w.path, w.here), list_contains(w.path, w.here) FROM walk w JOIN goals g ON w.here = g.goal_id WHERE NOT w.hit),
  cyc AS (SELECT goal_id, bool_or(hit) AS cyclic FROM walk GROUP BY goal_id),
  b AS (SELECT g.*, CASE WHEN cyclic THEN 'blocked_cycle' WHEN g.status <> 'active' OR g.parent IS NULL OR p.status = 'completed' THEN NULL WHEN p.status IS NULL THEN 'blocked_missing_parent' WHEN p.status = 'paused' THEN 'blocked_paused_parent' ELSE 'blocked_incomplete_parent' END AS block,
    CASE g.status WHEN 'active' THEN 0 WHEN 'paused' THEN 1 WHEN 'completed' THEN 2 ELSE 99 END AS rank FROM goals g JOIN cyc USING (goal_id) LEFT JOIN goals p ON g.parent = p.goal_id)"""


@query(f"WITH RECURSIVE {GOALS_SQL} SELECT goal_id, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS title, block, row_number() OVER (PARTITION BY owner ORDER BY rank, -priority, created_at, goal_id)::INTEGER AS place FROM b")
def goal_blocks(spark, sf):
    """Which goals are blocked and why, in their owner's order of work."""
    rows = planning.with_blocks(GOALS.df(spark, sf))
    return rows.select("goal_id", planning.normal_title(col("title")).alias("title"), "block", F.row_number().over(W.partitionBy("owner").orderBy(*planning.work_order())).alias("place"))


@query(f"""WITH RECURSIVE {GOALS_SQL}, {TURNS.cte}, n AS (SELECT *, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS t FROM b), u AS (SELECT *, array_to_string(regexp_extract_all(lower(message), '[a-z0-9]+'), ' ') AS mt FROM turns),
  o AS (SELECT m, 0 AS how, 0 AS size, n.* FROM u JOIN n ON u.owner = n.owner AND contains(lower(message), lower(goal_id)) UNION ALL SELECT m, 1, -length(t), n.* FROM u JOIN n ON u.owner = n.owner AND t <> '' AND contains(mt, t) UNION ALL SELECT m, 2, 0, n.* FROM u JOIN (SELECT * FROM n WHERE block IS NULL QUALIFY row_number() OVER (PARTITION BY owner ORDER BY rank, -priority, created_at, goal_id) = 1) n ON u.owner = n.owner),
  f AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY how, size, rank, -priority, created_at, goal_id) AS rn FROM o)
  SELECT m, goal_id AS selected, CASE how WHEN 0 THEN 'explicit_goal_id_override' WHEN 1 THEN 'explicit_goal_title_override' ELSE 'automatic_' || status || '_goal_selection' END AS reason, block AS blocked,
  CASE how WHEN 0 THEN CASE WHEN block IS NULL THEN 1.0 ELSE 0.65 END WHEN 1 THEN CASE WHEN block IS NULL THEN 0.95 ELSE 0.6 END ELSE CASE status WHEN 'active' THEN 0.9 WHEN 'paused' THEN 0.75 ELSE 0.6 END END::DOUBLE AS confidence FROM f WHERE rn = 1""")
def goal_plans(spark, sf):
    """The goal of its owner that each message is about."""
    return planning.plan_turns(TURNS.df(spark, sf), GOALS.df(spark, sf))


GOAL_LOG = Rows("goal_log", "ts int, goal string, event string, parent string", ((1, "a", "create", None), (2, "b", "create", None), (3, "a", "pause", None), (4, "a", "resume", None), (5, "c", "split", "b"), (6, "d", "split", "b"), (7, "c", "complete", None), (8, "a", "complete", None), (9, "e", "create", None), (10, "e", "pause", None))).over("supplier", "t.s_suppkey", True, goal="p.goal || '-' || t.s_suppkey", parent="p.parent || '-' || t.s_suppkey")


@query(f"""WITH {GOAL_LOG.cte}, e AS (SELECT ts, goal, CASE event WHEN 'pause' THEN 'paused' WHEN 'complete' THEN 'completed' ELSE 'active' END AS status FROM goal_log UNION ALL SELECT ts, parent, 'paused' FROM goal_log WHERE event = 'split')
  SELECT goal, arg_max(status, ts) AS status, count(*) AS changes FROM e GROUP BY goal""")
def goal_states(spark, sf):
    """The state of each goal after its log; a split pauses the parent."""
    log = GOAL_LOG.df(spark, sf)
    own = log.select("ts", "goal", F.when(col("event") == "pause", "paused").when(col("event") == "complete", "completed").otherwise("active").alias("status"))
    split = log.where("event = 'split'").select("ts", col("parent").alias("goal"), F.lit("paused").alias("status"))
    return own.union(split).groupBy("goal").agg(F.max_by("status", "ts").alias("status"), F.count("*").alias("changes"))


STATES = ("pending", "planning", "running", "verifying", "reporting", "done")


@query(f"SELECT user_id, [{', '.join(literal(s) for s in STATES)}][least(count(*) FILTER (WHERE event_type = 'click'), 5) + 1] AS state, bool_or(event_type = 'error' AND value > 9.9) AS failed FROM events GROUP BY user_id")
def workflow_states(spark, sf):
    """Linear workflows: each step event moves one of six states on."""
    steps = F.least(F.count_if(col("event_type") == "click"), F.lit(5)).cast("int") + 1
    e = table(spark, sf, "events").groupBy("user_id").agg(steps.alias("k"), F.coalesce(F.bool_or((col("event_type") == "error") & (col("value") > 9.9)), F.lit(False)).alias("failed"))
    return e.select("user_id", F.element_at(F.array(*map(F.lit, STATES)), col("k")).alias("state"), "failed")


# --- memories ---

MEM_SQL = f"mem AS (SELECT conv_id * 1000 + turn AS id, conv_id, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({MEM_STOP}))) AS toks, (1 + turn % 5) / 5.0 AS importance, 1790000000 + conv_id * 50000 + turn * 60 AS ts FROM conversations)"


def _memories(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select((col("conv_id") * 1000 + col("turn")).alias("id"), "conv_id", "text", memory.content_tokens(col("text")).alias("toks"), ((1 + col("turn") % 5) / 5.0).alias("importance"), (F.lit(1790000000) + col("conv_id") * 50000 + col("turn") * 60).alias("ts"))


ASKED = ["with", "on", "er", "der", "la"]


@query(f"WITH {MEM_SQL} SELECT id, len(list_intersect(toks, {ASKED}))::INTEGER AS shared, round(len(list_intersect(toks, {ASKED})) * importance, 6)::DOUBLE AS score FROM mem WHERE len(list_intersect(toks, {ASKED})) > 0 ORDER BY score DESC, id LIMIT 20")
def memory_recall(spark, sf):
    """Memories that share tokens with a query, by shared tokens and importance: the top 20."""
    shared = F.size(F.array_intersect("toks", F.array(*map(F.lit, ASKED))))
    return _memories(spark, sf).where(shared > 0).select("id", shared.alias("shared"), F.round(shared * col("importance"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"WITH {MEM_SQL} SELECT id FROM mem WHERE list_has_any(toks, {ASKED}) ORDER BY id LIMIT 50")
def memory_search(spark, sf):
    """The first 50 memories with any of the query's tokens."""
    return _memories(spark, sf).where(F.arrays_overlap("toks", F.array(*map(F.lit, ASKED)))).select("id").orderBy("id").limit(50)


@query(f"WITH {MEM_SQL} SELECT id, importance::DOUBLE AS importance FROM mem ORDER BY importance DESC, ts DESC, id LIMIT 200")
def memory_prune(spark, sf):
    """The 200 memories that stay, by importance and time."""
    return graph.pruned(_memories(spark, sf), 200, [F.desc("importance"), F.desc("ts"), col("id")]).select("id", "importance")


@query(f"WITH {MEM_SQL} SELECT id, text FROM mem WHERE conv_id % 2 = 0 ORDER BY id DESC LIMIT 100".replace("conv_id % 2 = 0", "importance > 0.3"))
def memory_list(spark, sf):
    """The newest 100 memories that aren't archived."""
    return _memories(spark, sf).where("importance > 0.3").select("id", "text").orderBy(F.desc("id")).limit(100)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn <= 5")
def recent_events(spark, sf):
    """The newest five events of each session, errors left out."""
    return memory.recent(table(spark, sf, "events").where("event_type <> 'error'"), "user_id", "event_id", 5).select("user_id", "event_id", "event_type")


REMEMBERED = Rows(
    "remembered",
    "id int, importance double, uses int, text string",
    (
        (1, 0.9, 2, "red boats sail past green harbours quickly today"), (2, 0.8, 1, "red boats sail past green harbours quickly"), (3, 0.7, 5, "wheat fields ripen under warm summer skies"), (4, 0.6, 1, "boats sail past green harbours quickly today red"), (5, 0.5, 4, "nothing alike stands here"),
        (6, 0.4, 3, "wheat fields ripen under warm summer skies slowly"),
    ),
)


@query(f"WITH {MEM_SQL}, {REMEMBERED.cte}, mm AS (SELECT id, toks FROM mem UNION ALL SELECT -id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({MEM_STOP}))) FROM remembered), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.toks, b.toks))::DOUBLE AS i, len(a.toks) + len(b.toks) AS n FROM mm a JOIN mm b ON a.id < b.id AND len(a.toks) > 0 AND len(b.toks) > 0) SELECT a, b, round(i / (n - i), 6) AS jaccard FROM p WHERE i / (n - i) >= 0.6")
def memory_links(spark, sf):
    """Pairs of memories with a token Jaccard of 0.6: candidates share one of the rarest tokens that such a pair must share."""
    written = REMEMBERED.df(spark).select((-col("id")).cast("long").alias("id"), memory.content_tokens(col("text")).alias("toks"))
    m = materialize(_memories(spark, sf).select("id", "toks").union(written).where(F.size("toks") > 0), "memories")
    return similarity.gram_pairs(m.select(col("id").alias("a"), col("toks").alias("grams")), 0.6).withColumn("jaccard", F.round("jaccard", 6))


LINKS = Rows("links", "a int, b int", ((1, 2), (2, 3), (3, 4), (1, 5), (5, 1), (6, 7), (4, 8))).over("customer", "t.c_custkey", True, a="t.c_custkey * 4 + p.a", b="t.c_custkey * 4 + p.b")


@query(f"WITH {LINKS.cte}, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), h1 AS (SELECT a AS start, b AS id, 1 AS hop FROM e), h2 AS (SELECT DISTINCT start, e.b AS id, 2 AS hop FROM h1 JOIN e ON h1.id = e.a WHERE e.b <> start) SELECT start, id, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY start, id")
def memory_chains(spark, sf):
    """Memories within two links of each, links holding both ways."""
    one = LINKS.df(spark, sf)
    e = one.union(one.select("b", "a")).distinct()
    h1 = e.select(col("a").alias("start"), col("b").alias("id"), F.lit(1).alias("hop"))
    h2 = h1.join(e, col("id") == col("a")).where("b <> start").select("start", col("b").alias("id"), F.lit(2).alias("hop"))
    return h1.union(h2).groupBy("start", "id").agg(F.min("hop").alias("hop"))


@query(f"WITH {MEM_SQL}, l AS (SELECT toks FROM mem ORDER BY id DESC LIMIT 200), q AS (SELECT id, toks FROM mem) SELECT q.id, max(CASE WHEN len(q.toks) + len(l.toks) = 0 THEN 1.0 ELSE len(list_intersect(q.toks, l.toks))::DOUBLE / (len(q.toks) + len(l.toks) - len(list_intersect(q.toks, l.toks))) END) >= 0.92 AS known FROM q, l GROUP BY q.id")
def memory_known(spark, sf):
    """Whether a text is near (Jaccard 0.92) one of the latest 200 memories."""
    m = _memories(spark, sf).select("id", "toks")
    return memory.known_near(m, m.orderBy(F.desc("id")).limit(200).select("toks"), 0.92)


OWNED = REMEMBERED.over("supplier", "t.s_suppkey", True, id="-(t.s_suppkey * 10 + p.id)", text="p.text || ' owner' || t.s_suppkey || ' key' || t.s_suppkey")


@query()
def memory_consolidation(spark, sf):
    """Turns and suppliers' notes as memories: those near a more important one (Jaccard 0.8) go, and their uses are added to it."""
    m = _memories(spark, sf).select("id", "importance", (col("id") % 7 + 1).cast("int").alias("uses"), "toks")
    written = OWNED.df(spark, sf).select(col("id").cast("long").alias("id"), "importance", "uses", memory.content_tokens(col("text")).alias("toks"))
    return memory.consolidate(m.union(written))


_BLANK = r"[ \t\n\r\f\x0B]"
_SUM_STOP = ", ".join(literal(w) for w in summaries.STOP)
SUMMARY_SQL = rf"""RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w, unnest(range(len(regexp_extract_all(lower(t), '[a-z0-9]+')))) AS pos FROM d),
  c AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rk FROM w GROUP BY doc_id, w), keys AS (SELECT doc_id, list(w) AS k FROM c WHERE rk <= 40 AND w NOT IN ({_SUM_STOP}) AND length(w) > 2 GROUP BY doc_id),
  l AS (SELECT doc_id, t, string_split(regexp_replace(t, '([.!?]){_BLANK}+', '\1' || chr(1), 'g'), chr(1)) AS l FROM d), s AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS sent FROM l),
  v AS (SELECT s.doc_id, i, sent, regexp_extract_all(lower(sent), '[a-z0-9]+') AS ws, coalesce(k, []) AS k FROM s LEFT JOIN keys USING (doc_id)), sc AS (SELECT doc_id, i, sent, CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(ws), k))::DOUBLE / len(ws) END AS score FROM v)"""


@query(f"WITH {SUMMARY_SQL} SELECT doc_id, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 4) AS total FROM sc GROUP BY doc_id")
def sentence_scores(spark, sf):
    """Each document's sentences scored by key words: their number, the best and the sum."""
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("total", T.DoubleType())])

    @F.arrow_udf(kind)
    def scores(text: pa.Array) -> pa.Array:
        got = [[v for _, v in summaries.sentence_scores((t or "").strip(" \t\n\r\f\x0b"))] for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([len(g) for g in got], pa.int64()), pa.array([max(g) for g in got], pa.float64()), pa.array([float(sum(g)) for g in got], pa.float64())], names=["n", "best", "total"])

    s = table(spark, sf, "documents").select("doc_id", scores.asNondeterministic()("text").alias("s"))
    return s.select("doc_id", "s.n", F.round("s.best", 6).alias("best"), F.round("s.total", 4).alias("total"))


@query(f"""WITH {SUMMARY_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rk FROM sc WHERE regexp_matches(sent, '[^ \t\n\r\f\x0B]')),
  f(doc_id, rk, total, i, took, done) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, false, false FROM d WHERE length(t) > 300 UNION ALL SELECT o.doc_id, o.rk, f.total + CASE WHEN f.total + length(sent) + 2 <= 300 THEN length(sent) + 2 ELSE 0 END, o.i, f.total + length(sent) + 2 <= 300, f.total + length(sent) + 2 <= 300 AND f.total + length(sent) + 2 >= 270
    FROM f JOIN o ON o.doc_id = f.doc_id AND o.rk = f.rk + 1 WHERE NOT f.done),
  p AS (SELECT f.doc_id, string_agg(sc.sent, ' ' ORDER BY sc.i) AS s FROM f JOIN sc ON sc.doc_id = f.doc_id AND sc.i = f.i WHERE took GROUP BY f.doc_id),
  r AS (SELECT d.doc_id, t, CASE WHEN length(t) <= 300 THEN t ELSE coalesce(s, regexp_replace(left(t, 300), ' [^ ]*$', '') || '…') END AS s FROM d LEFT JOIN p USING (doc_id))
  SELECT doc_id, sha256(s) AS summary, length(t) > 500 AND s <> '' AND length(s) < 0.7 * length(t) AS compressed FROM r""")
def document_summaries(spark, sf):
    """Summaries of all documents, and which texts a summary would take the place of."""
    d = table(spark, sf, "documents").select("doc_id", "text", summaries.summarise()(col("text")).alias("s"))
    n = F.length(F.regexp_replace("text", "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$", ""))
    return d.select("doc_id", F.sha2("s", 256).alias("summary"), ((n > 500) & (col("s") != "") & (F.length("s") < 0.7 * n)).alias("compressed"))


# --- knowledge graph ---


@query(f"WITH {TRIPLES_SQL} SELECT subject || ' ' || relation || ' ' || object || '.' AS text, round(confidence, 3)::DOUBLE AS confidence FROM tr WHERE confidence >= 0.7 ORDER BY tr.confidence DESC, subject, relation, object LIMIT 10000")
def kg_export(spark, sf):
    """Confident triples as sentences."""
    t = _triples(spark, sf).where("confidence >= 0.7").orderBy(F.desc("confidence"), "subject", "relation", "object").limit(10_000)
    return t.select(F.concat(F.concat_ws(" ", "subject", "relation", "object"), F.lit(".")).alias("text"), F.round("confidence", 3).alias("confidence"))


@query(f"WITH {TRIPLES_SQL} SELECT subject, object, round(confidence, 6)::DOUBLE AS confidence FROM tr WHERE relation = 'located_in' AND object = 'NATION_7' AND confidence >= 0.6 ORDER BY tr.confidence DESC, subject LIMIT 30")
def kg_lookup(spark, sf):
    """Triples by relation and object, the most confident 30."""
    t = _triples(spark, sf).where("relation = 'located_in' and object = 'NATION_7' and confidence >= 0.6")
    return t.orderBy(F.desc("confidence"), "subject").limit(30).select("subject", "object", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {TRIPLES_SQL} SELECT entity, count(*) AS mentions FROM (SELECT subject AS entity FROM tr UNION ALL SELECT object FROM tr) GROUP BY entity ORDER BY mentions DESC, entity LIMIT 100")
def kg_entities(spark, sf):
    return graph.entity_mentions(_triples(spark, sf))


@query(f"WITH {TRIPLES_SQL} SELECT subject, relation, object FROM tr ORDER BY confidence DESC, subject, relation, object LIMIT 500")
def kg_prune(spark, sf):
    """The 500 triples that stay, by confidence."""
    return graph.pruned(_triples(spark, sf), 500, [F.desc("confidence"), col("subject"), col("relation"), col("object")]).select("subject", "relation", "object")


@query(f"WITH {TRIPLES_SQL} SELECT subject, relation, object, round(least(1.0, greatest(0.0, confidence + CASE relation WHEN 'part_of' THEN 0.3 ELSE -0.6 END)), 6)::DOUBLE AS confidence FROM tr")
def kg_adjust(spark, sf):
    """Confidences moved and kept within 0 and 1."""
    moved = col("confidence") + F.when(col("relation") == "part_of", 0.3).otherwise(-0.6)
    return _triples(spark, sf).select("subject", "relation", "object", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved)), 6).alias("confidence"))


@query(f"WITH {TRIPLES_SQL}, h AS (SELECT *, list_distinct(regexp_extract_all(lower(subject || ' ' || relation || ' ' || object), '[a-z0-9]+')) AS t FROM tr), s AS (SELECT subject, relation, object, round(0.6 * (len(list_intersect(t, ['7', 'nation', 'europe'])) / 3.0) + 0.4 * confidence, 6)::DOUBLE AS score FROM h WHERE len(list_intersect(t, ['7', 'nation', 'europe'])) > 0) SELECT * FROM s WHERE score > 0.1 ORDER BY score DESC, subject, relation, object LIMIT 20")
def kg_ranked(spark, sf):
    """Triples by token overlap and confidence."""
    return graph.ranked_triples(_triples(spark, sf), ["7", "nation", "europe"]).select("subject", "relation", "object", "score")


@query(f"WITH {TRIPLES_SQL} SELECT subject, relation, object FROM tr WHERE list_has_any(regexp_extract_all(lower(subject || ' ' || relation || ' ' || object), '[a-z0-9]+'), ['africa', 'asia']) ORDER BY confidence DESC, subject, relation, object LIMIT 20")
def kg_text_search(spark, sf):
    """Triples with any of the words, the most confident 20."""
    held = X.alnum_tokens(F.concat_ws(" ", "subject", "relation", "object"))
    return _triples(spark, sf).where(F.arrays_overlap(held, F.array(F.lit("africa"), F.lit("asia")))).orderBy(F.desc("confidence"), "subject", "relation", "object").limit(20).select("subject", "relation", "object")


FACTS = Rows(
    "facts",
    "id int, text string",
    (
        (1, "The Rhine is a long river, Basel is located in Switzerland. Engines use diesel fuel"), (2, "Smoking causes serious illness. Smoking causes serious illness."), (3, "Anna works at Northern Mills. Anna created the atlas"), (4, "Wheat depends on rain, Clouds produce rain, Rain precedes Harvest"),
        (5, "Felix is named Whiskers. A cat is an instance of Animal"), (6, "Latin means old speech. Bread contains yeast. Oil prevents rust"), (7, "nothing here"), (8, "French is derived from Latin. Steel enables tall towers. Facts contradict rumours"), (9, "Bern belongs to Switzerland and has many bears. Plum similar to Cherry"),
    ),
).over("conversations", "t.conv_id * 31 + t.turn", id="t.conv_id * 1000 + t.turn", text="p.text || '. ' || t.text")
_CUT = lambda x: f"substr(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), 1, 60)"
FOUND_SQL = f"""{FACTS.cte}, m AS ({' UNION ALL '.join(f"SELECT id, {k} AS pat, {literal(r)} AS relation, unnest(regexp_extract_all(text, {literal(p)}, 1)) AS s, unnest(regexp_extract_all(text, {literal(p)}, 2)) AS o, unnest(range(len(regexp_extract_all(text, {literal(p)})))) AS pos FROM facts" for k, (r, p) in enumerate(graph.TRIPLE_PATTERNS))}),
  c AS (SELECT id, pat, pos, relation, {_CUT('s')} AS subject, {_CUT('o')} AS object FROM m), f AS (SELECT *, row_number() OVER (PARTITION BY id, lower(subject), relation, lower(object) ORDER BY pat, pos) AS rn FROM c WHERE length(subject) > 2 AND length(object) > 2)"""


@query(f"WITH {FOUND_SQL} SELECT id, subject, relation, object FROM f WHERE rn = 1")
def kg_extract(spark, sf):
    """Triples found in texts by twenty patterns."""
    return graph.extract_triples(FACTS.df(spark, sf))


KNOWN = ("is", "has", "uses", "created", "works_at", "located_in", "part_of", "contains", "causes", "depends_on")


@query(f"WITH RECURSIVE cf(n, confidence) AS (SELECT 1, 0.7::DOUBLE UNION ALL SELECT n + 1, round(least(1.0, confidence + (1 - confidence) * 0.7::DOUBLE * 0.5::DOUBLE), 4) FROM cf WHERE n < 200), {FOUND_SQL}, o AS (SELECT lower(subject) AS subject, relation, lower(object) AS object, count(*)::INTEGER AS n FROM f WHERE rn = 1 AND relation IN {KNOWN} GROUP BY 1, 2, 3) SELECT subject, relation, object, o.n AS mentions, confidence FROM o JOIN cf ON cf.n = least(o.n, 200)")
def kg_ingest(spark, sf):
    """Found triples of known relations, put into the graph with a confidence of 0.7 each."""
    t = graph.extract_triples(FACTS.df(spark, sf)).where(col("relation").isin(*KNOWN))
    seen = t.select(F.lower("subject").alias("subject"), "relation", F.lower("object").alias("object"), "id", F.lit(0.7).alias("confidence"))
    return graph.fold_confidence(seen, ["subject", "relation", "object"], ["id"]).select("subject", "relation", "object", "mentions", "confidence")


# --- feedback and exports ---

FEEDBACK_SQL = f"""fb AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session, text AS question, answer, (conv_id % 3 - 1)::INTEGER AS rating, CASE WHEN conv_id % 5 <> 0 THEN (turn % 10) / 10.0 END::DOUBLE AS confidence, CASE WHEN turn % 4 = 0 THEN 'joy' ELSE '' END AS emotion, CASE WHEN turn % 3 = 0 THEN 'learning' ELSE 'support' END AS intent
  FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE role = 'user' AND answer IS NOT NULL)"""
RED = lambda x: sql_replaced(x, ((K.MAIL, "[REDACTED]"), (K.SOCIAL, "[REDACTED]"), (K.EXPORT_SECRET, "[REDACTED]")))


def _feedback(spark, sf):
    """A user's turn and the next one as question and answer; ratings and the like are made up from their numbers."""
    c = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("role = 'user' and answer is not null")
    return c.select(
        (col("conv_id") * 1000 + col("turn")).alias("id"), col("conv_id").alias("session"), col("text").alias("question"), "answer", (col("conv_id") % 3 - 1).cast("int").alias("rating"),
        F.when(col("conv_id") % 5 != 0, (col("turn") % 10) / 10.0).alias("confidence"), F.when(col("turn") % 4 == 0, "joy").otherwise("").alias("emotion"), F.when(col("turn") % 3 == 0, "learning").otherwise("support").alias("intent"),
    )


_OK = f"(len({sql_words('q')}) >= 3 AND len({sql_words('a')}) >= 5 AND len(list_distinct({sql_words(chr(108) + 'ower(q || chr(32) || a)')}))::DOUBLE / len({sql_words('q || chr(32) || a')}) >= 0.25)"
EXPORTS = {
    "conversation": ("rating >= 1", 5000, _OK),
    "reasoning": ("rating > 0 AND confidence IS NOT NULL", 1000, _OK),
    "teaching": ("rating > 0 AND intent = 'learning'", 2000, _OK),
    "emotion": ("emotion <> ''", 2000, f"len({sql_words('q')}) >= 3"),
    "retrieval": ("true", 2000, f"len({sql_words('q')}) >= 2 AND len({sql_words('a')}) >= 5"),
}


@query(f"WITH {FEEDBACK_SQL}, " + ", ".join(f"e_{k} AS (SELECT '{k}' AS type, id, q, a FROM (SELECT id, {RED('question')} AS q, {RED('answer')} AS a FROM (SELECT * FROM fb WHERE {where} ORDER BY id DESC LIMIT {n})) WHERE {ok})" for k, (where, n, ok) in EXPORTS.items()) + " SELECT type, id, sha256(q) AS prompt, sha256(a) AS response FROM (" + " UNION ALL ".join(f"SELECT * FROM e_{k}" for k in EXPORTS) + ")")
def feedback_exports(spark, sf):
    """Training examples of five kinds out of feedback: the newest rows of a kind, redacted, then the quality rules."""
    fb, out = _feedback(spark, sf), None
    for kind, (where, n, _) in EXPORTS.items():
        part = fb.where(where).orderBy(F.desc("id")).limit(n).select(F.lit(kind).alias("type"), "id", K.redact_export(col("question")).alias("q"), K.redact_export(col("answer")).alias("a"))
        words = F.size(X.words(col("q")))
        ok = {"emotion": words >= 3, "retrieval": (words >= 2) & (F.size(X.words(col("a"))) >= 5)}.get(kind, K.pair_ok(col("q"), col("a")))
        part = part.where(ok)
        out = part if out is None else out.union(part)
    return out.select("type", "id", F.sha2("q", 256).alias("prompt"), F.sha2("a", 256).alias("response"))


@query(f"WITH {FEEDBACK_SQL} SELECT id, rating, confidence FROM fb WHERE rating < 0 OR confidence < 0.4 ORDER BY id DESC LIMIT 100")
def hard_feedback(spark, sf):
    return _feedback(spark, sf).where("rating < 0 or confidence < 0.4").orderBy(F.desc("id")).limit(100).select("id", "rating", "confidence")


@query(f"WITH {FEEDBACK_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE rating > 0) AS positive, count(*) FILTER (WHERE rating < 0) AS negative, round(count(*) FILTER (WHERE rating > 0)::DOUBLE / count(*), 4) AS share FROM fb")
def feedback_analytics(spark, sf):
    return _feedback(spark, sf).agg(F.count("*").alias("total"), F.count_if(col("rating") > 0).alias("positive"), F.count_if(col("rating") < 0).alias("negative"), F.round(F.count_if(col("rating") > 0) / F.count("*"), 4).alias("share"))


@query(f"WITH {MEM_SQL}, m AS (SELECT id, {RED('text')} AS t FROM (SELECT * FROM mem ORDER BY id DESC LIMIT 5000)) SELECT id, sha256(t) AS text FROM m WHERE len({sql_words('t')}) >= 5")
def memory_export(spark, sf):
    m = _memories(spark, sf).orderBy(F.desc("id")).limit(5000).select("id", K.redact_export(col("text")).alias("t"))
    return m.where(F.size(X.words(col("t"))) >= 5).select("id", F.sha2("t", 256).alias("text"))


@query("SELECT event_id, user_id AS query, 'page' || (event_id % 7) AS passage, (value > 5)::INTEGER AS label FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL")
def reranker_examples(spark, sf):
    """Feedback rows as (query, passage, label)."""
    e = table(spark, sf, "events").where(col("event_type").isin("click", "view") & col("value").isNotNull())
    return e.select("event_id", col("user_id").alias("query"), F.concat(F.lit("page"), (col("event_id") % 7).cast("string")).alias("passage"), (col("value") > 5).cast("int").alias("label"))


@query("SELECT event_id, user_id AS query, 'query_rewrite_candidate' AS type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 500")
def rewrite_candidates(spark, sf):
    """The newest 500 misses."""
    return table(spark, sf, "events").where("event_type = 'error'").orderBy(F.desc("event_id")).limit(500).select("event_id", col("user_id").alias("query"), F.lit("query_rewrite_candidate").alias("type"))


@query("""WITH g AS (SELECT user_id, count(*) FILTER (WHERE value > 5) AS useful, count(*) FILTER (WHERE value <= 5) AS not_useful, array_to_string((list(event_type || ':' || event_id ORDER BY event_id))[1:3], ',') AS sample FROM events WHERE value IS NOT NULL GROUP BY user_id)
  SELECT * FROM g WHERE not_useful >= 3 ORDER BY not_useful DESC, user_id LIMIT 50""")
def hard_queries(spark, sf):
    """Queries whose results were not useful three times or more, with three sample results."""
    e = table(spark, sf, "events").where("value is not null")
    first = e.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))).where("rn <= 3")  # three rows a query, so collecting them is bounded
    sample = first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat_ws(":", x["event_type"], x["event_id"].cast("string"))), ",").alias("sample"))
    g = e.groupBy("user_id").agg(F.count_if(col("value") > 5).alias("useful"), F.count_if(col("value") <= 5).alias("not_useful")).where("not_useful >= 3")
    return g.join(sample, "user_id").orderBy(F.desc("not_useful"), "user_id").limit(50)


# --- parts of retrieval ---

SYNONYMS = Rows("synonyms", "term string, syns array<string>", (("graph", ["network", "chart", "plot"]), ("bug", ["defect"]), ("python", ["snake", "language"])))


@query(f"WITH {MESSAGES.cte}, {SYNONYMS.cte}, t AS (SELECT id, text, unnest(string_split(lower(text), ' ')) AS term, unnest(range(len(string_split(lower(text), ' ')))) AS pos FROM messages), x AS (SELECT id, array_to_string(flatten(list(syns[1:2] ORDER BY pos)), ' ') AS more FROM t JOIN synonyms USING (term) GROUP BY id) SELECT m.id, m.text || coalesce(' ' || more, '') AS text FROM messages m LEFT JOIN x USING (id)")
def query_expansion(spark, sf):
    """Queries with up to two synonyms of each of their terms."""
    t = MESSAGES.df(spark, sf).select("id", F.posexplode(F.split(F.lower("text"), " ")).alias("at", "term"))
    more = t.join(F.broadcast(SYNONYMS.df(spark)), "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.slice("syns", 1, 2).alias("s")))).alias("x"))
    text = F.array_join(F.flatten(F.transform("x", lambda y: y["s"])), " ")
    return MESSAGES.df(spark, sf).join(more, "id", "left").select("id", F.concat("text", F.when(col("x").isNotNull(), F.concat(F.lit(" "), text)).otherwise("")).alias("text"))


PASSAGES = Rows("passages", "pid int, body string", ((1, "teach me about graphs and latin"), (2, "list memories of the past"), (3, "the bug is fixed, no error"), (4, "compare python and java options"), (5, "why is it slow"), (6, "entropy of a system and how it works")))


@query(f"""WITH {MESSAGES.cte}, {PASSAGES.cte}, s AS (SELECT id, pid, len(list_intersect(q, p))::DOUBLE / greatest(len(list_distinct(list_concat(q, p))), 1) AS score FROM (SELECT id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM messages), (SELECT pid, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) AS p FROM passages)),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 4) DESC, pid)::INTEGER AS rank FROM s) SELECT id, pid, round(score, 4) AS score, rank FROM r WHERE rank <= 3""")
def rerank_topk(spark, sf):
    """The three passages nearest to each query by token overlap."""
    from millrace.operators import retrieval

    q = MESSAGES.df(spark, sf).select("id", F.array_distinct(X.alnum_tokens(col("text"))).alias("q"))
    p = PASSAGES.df(spark).select("pid", F.array_distinct(X.alnum_tokens(col("body"))).alias("p"))
    score = F.round(F.size(F.array_intersect("q", "p")) / F.greatest(F.size(F.array_union("q", "p")), F.lit(1)), 4)
    scored = q.join(F.broadcast(p)).select("id", "pid", score.alias("score"))  # a query's candidates
    return retrieval.top(scored, ["id"], [F.desc("score"), col("pid")], 3)


COSINE = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / ((sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1e-9) * (sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-9))"


@query(f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({COSINE}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND q.label = v.label) WHERE score > 0.1) WHERE rank <= 5")
def document_topk(spark, sf):
    """The five nearest vectors within the query's own document (its label) over 0.1."""
    from millrace.operators import vector_index

    e = table(spark, sf, "embeddings")
    return vector_index.exact_top(e, e.where("vec_id % 50 = 0"), 5, within="label").where("score > 0.1")


@query(f"SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round({COSINE}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id SEMI JOIN (SELECT label AS l FROM embeddings WHERE label IN (1, 3)) w ON v.label = w.l)) WHERE rank <= 5")
def workspace_search(spark, sf):
    """The five nearest vectors of the workspace's documents (labels 1 and 3)."""
    from millrace.operators import vector_index

    e = table(spark, sf, "embeddings")
    return vector_index.exact_top(e.where("label in (1, 3)"), e.where("vec_id % 50 = 0"), 5).select("query_id", "vec_id", "score")


@query("WITH u AS (SELECT 0 AS leg, doc_id, text FROM documents WHERE source = 'src0' UNION ALL SELECT 1, doc_id, text FROM documents WHERE source <> 'src0'), r AS (SELECT *, row_number() OVER (PARTITION BY left(text, 80) ORDER BY leg, doc_id) AS rn FROM u) SELECT leg::INTEGER AS leg, doc_id FROM r WHERE rn = 1")
def retrieval_union(spark, sf):
    """Two result lists as one: of rows that begin with the same 80 characters, the first of the first list stays."""
    d = table(spark, sf, "documents").select((col("source") != "src0").cast("int").alias("leg"), "doc_id", F.left("text", F.lit(80)).alias("k"))
    return d.groupBy("k").agg(F.min(F.struct("leg", "doc_id")).alias("f")).select("f.leg", "f.doc_id")


@query("""WITH e AS (SELECT 'memory' AS kind, conv_id * 1000 + turn AS id, (turn % 10) / 10.0::DOUBLE AS score FROM conversations UNION ALL SELECT 'chunk', doc_id, (doc_id % 97) / 97.0 FROM documents UNION ALL SELECT 'graph', c_custkey, 0.5 + (c_custkey % 50) / 100.0 FROM customer UNION ALL SELECT 'tool', 1, 0.9),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rn FROM e) SELECT kind, id, round(score, 6)::DOUBLE AS score, round(avg(score) OVER (), 6)::DOUBLE AS confidence FROM r WHERE rn <= 5""")
def evidence_union(spark, sf):
    """The five best rows of each kind of evidence and their mean score."""
    from millrace.operators import retrieval

    m = table(spark, sf, "conversations").select(F.lit("memory").alias("kind"), (col("conv_id") * 1000 + col("turn")).alias("id"), ((col("turn") % 10) / 10.0).alias("score"))
    d = table(spark, sf, "documents").select(F.lit("chunk").alias("kind"), col("doc_id").alias("id"), ((col("doc_id") % 97) / 97.0).alias("score"))
    g = table(spark, sf, "customer").select(F.lit("graph").alias("kind"), col("c_custkey").alias("id"), (0.5 + (col("c_custkey") % 50) / 100.0).alias("score"))
    t = spark.range(1, 2).select(F.lit("tool").alias("kind"), "id", F.lit(0.9).alias("score"))
    best = retrieval.top(m.union(d).union(g).union(t), ["kind"], [F.desc("score"), col("id")], 5)
    return best.join(F.broadcast(best.agg(F.round(F.avg("score"), 6).alias("confidence")))).select("kind", "id", F.round("score", 6).alias("score"), "confidence")


@query(f"WITH {MESSAGES.cte}, {PASSAGES.cte}, q AS (SELECT id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS q FROM messages), p AS (SELECT list_distinct(flatten(list(regexp_extract_all(lower(body), '[a-z]{{3,}}')))) AS p FROM passages) SELECT id, array_to_string(list_sort(list_filter(q, lambda t: NOT list_contains(p, t))), ',') AS gap FROM q, p")
def evidence_gap(spark, sf):
    """The terms of each question that no evidence holds."""
    have = PASSAGES.df(spark).select(F.explode(K.long_words(col("body"))).alias("t")).distinct()
    asked = MESSAGES.df(spark, sf).select("id", F.explode_outer(K.long_words(col("text"))).alias("t"))
    missing = asked.join(have, "t", "left_anti").where("t is not null").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("gap"))
    return MESSAGES.df(spark, sf).join(missing, "id", "left").select("id", F.coalesce("gap", F.lit("")).alias("gap"))


@query("SELECT doc_id, substr(md5(source || ':' || doc_id || ':' || left(text, 40)), 1, 12) AS chunk_id FROM documents WHERE length(text) >= 40 AND text NOT IN (SELECT text FROM documents WHERE source = 'src0') AND source <> 'src0'")
def index_append(spark, sf):
    """Chunks that an index of one source's texts doesn't hold yet, with their ids."""
    d = table(spark, sf, "documents").withColumn("h", F.sha2("text", 256))
    new = d.where("length(text) >= 40 and source <> 'src0'").join(d.where("source = 'src0'").select("h"), "h", "left_anti")
    return new.select("doc_id", F.substring(F.md5(F.concat_ws(":", "source", "doc_id", F.left("text", F.lit(40)))), 1, 12).alias("chunk_id"))


WORDS_OF = lambda s: f"(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE source = '{s}')"


@query(f"WITH a AS {WORDS_OF('src0')}, b AS {WORDS_OF('src1')} SELECT (SELECT count(*) FROM (SELECT w FROM a INTERSECT SELECT w FROM b)) AS shared, round((SELECT count(*) FROM (SELECT w FROM a INTERSECT SELECT w FROM b))::DOUBLE / (SELECT count(*) FROM (SELECT w FROM a UNION SELECT w FROM b)), 6) AS jaccard, (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT w FROM a EXCEPT SELECT w FROM b ORDER BY w LIMIT 30)) AS only_a, (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT w FROM b EXCEPT SELECT w FROM a ORDER BY w LIMIT 30)) AS only_b")
def compare_sources(spark, sf):
    """Two sources' vocabularies: what they share and the first words only one has."""
    d = table(spark, sf, "documents")
    words = lambda s: d.where(col("source") == s).select(F.explode(X.alnum_tokens(col("text"))).alias("w")).distinct()
    a, b = words("src0"), words("src1")
    n = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), "w", "full").agg(F.count_if(col("a") & col("b")).alias("shared"), F.count("*").alias("all"))
    only = lambda x, y, name: x.exceptAll(y).orderBy("w").limit(30).agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias(name))
    return n.join(F.broadcast(only(a, b, "only_a"))).join(F.broadcast(only(b, a, "only_b"))).select("shared", F.round(col("shared") / col("all"), 6).alias("jaccard"), "only_a", "only_b")


# --- review queue, shards, runs ---


@query("""WITH e AS (SELECT event_id % 200 AS item, event_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS s FROM events WHERE event_type <> 'view'), l AS (SELECT item, arg_max(s, event_id) AS state FROM e GROUP BY item)
  SELECT state, count(*) AS n FROM l GROUP BY state""")
def review_queue(spark, sf):
    """Items of a review queue by their last decision."""
    e = table(spark, sf, "events").where("event_type <> 'view'")
    state = F.when(col("event_type") == "purchase", "approved").when(col("event_type") == "error", "rejected").otherwise("pending")
    last = e.groupBy((col("event_id") % 200).alias("item")).agg(F.max_by(state, "event_id").alias("state"))
    return last.groupBy("state").agg(F.count("*").alias("n"))


SHARD_SQL = "s AS (SELECT (doc_id // 10)::BIGINT AS shard, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY 1), l AS (SELECT event_id % 40 AS shard, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'in_progress' ELSE 'pending' END, event_id) AS state FROM events GROUP BY 1), st AS (SELECT shard, tokens, coalesce(state, 'pending') AS state FROM s LEFT JOIN l USING (shard))"


def _shards(spark, sf):
    s = table(spark, sf, "documents").groupBy(F.floor(col("doc_id") / 10).alias("shard")).agg(F.sum("n_chars").alias("tokens"))
    state = F.when(col("event_type") == "purchase", "completed").when(col("event_type") == "click", "in_progress").otherwise("pending")
    last = table(spark, sf, "events").groupBy((col("event_id") % 40).alias("shard")).agg(F.max_by(state, "event_id").alias("state"))
    return s.join(last, "shard", "left").select("shard", "tokens", F.coalesce("state", F.lit("pending")).alias("state"))


@query(f"WITH {SHARD_SQL} SELECT count(*) AS shards, count(*) FILTER (WHERE state = 'completed') AS completed, count(*) FILTER (WHERE state = 'in_progress') AS in_progress, count(*) FILTER (WHERE state = 'pending') AS pending, round(100.0 * sum(tokens) FILTER (WHERE state = 'completed') / sum(tokens), 4)::DOUBLE AS progress FROM st")
def shard_progress(spark, sf):
    done = F.coalesce(F.sum(F.when(col("state") == "completed", col("tokens"))), F.lit(0))
    return _shards(spark, sf).agg(F.count("*").alias("shards"), *[F.count_if(col("state") == s).alias(s) for s in ("completed", "in_progress", "pending")], F.round(100.0 * done / F.sum("tokens"), 4).alias("progress"))


@query(f"WITH {SHARD_SQL}, n AS (SELECT min(shard) AS shard FROM st WHERE state = 'pending') SELECT shard, CASE WHEN shard = (SELECT shard FROM n) THEN 'in_progress' ELSE state END AS state, shard = (SELECT shard FROM n) AS taken FROM st")
def shard_claim(spark, sf):
    """The shards after the first pending one has been taken."""
    s = _shards(spark, sf)
    first = s.where("state = 'pending'").agg(F.min("shard").alias("first"))
    taken = F.coalesce(col("shard") == col("first"), F.lit(False))
    return s.join(F.broadcast(first)).select("shard", F.when(taken, "in_progress").otherwise(col("state")).alias("state"), taken.alias("taken"))


@query("""SELECT o_orderkey AS run, o_orderstatus AS status, count(*) AS sources, array_to_string(list_sort(list(DISTINCT l_suppkey))[1:3], ',') AS first_sources, round(sum(l_quantity), 2) AS tokens FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def run_provenance(spark, sf):
    """Runs with the sources of their release."""
    j = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), col("o_orderkey") == col("l_orderkey"))
    return j.groupBy(col("o_orderkey").alias("run"), col("o_orderstatus").alias("status")).agg(F.count("*").alias("sources"), F.array_join(F.slice(F.array_sort(F.collect_set("l_suppkey")), 1, 3).cast("array<string>"), ",").alias("first_sources"), F.round(F.sum("l_quantity"), 2).alias("tokens"))


@query("SELECT max(o_totalprice) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS tokens, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, round(sum(o_totalprice) / 3600, 2) AS hours FROM orders")
def run_totals(spark, sf):
    """Most tokens over closed runs, and the hours of all."""
    o = table(spark, sf, "orders")
    return o.agg(F.max(F.when(col("o_orderstatus").isin("F", "P"), col("o_totalprice"))).alias("tokens"), F.count_if(col("o_orderstatus") == "F").alias("completed"), F.round(F.sum("o_totalprice") / 3600, 2).alias("hours"))


@query("SELECT o_orderkey AS run, o_custkey AS checkpoint FROM orders WHERE o_custkey % 100 = 7 ORDER BY 1".replace("o_custkey % 100 = 7", "o_custkey = 7"))
def checkpoint_lineage(spark, sf):
    """The runs of one checkpoint."""
    return table(spark, sf, "orders").where("o_custkey = 7").select(col("o_orderkey").alias("run"), col("o_custkey").alias("checkpoint"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY user_id")
def events_by_source(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(col("event_type") == "error").alias("failed"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("WITH u AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 <> 0 UNION SELECT event_id, user_id, event_type FROM events) SELECT * FROM u".replace("WHERE event_id % 3 <> 0 ", "WHERE event_type <> 'view' "))
def all_events(spark, sf):
    """The approval log and the daily shards as one, each event once."""
    from millrace.operators import audit

    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return audit.union_logs(e.where("event_type <> 'view'"), e)


@query("SELECT event_type, CASE WHEN value IS NULL THEN 'none' WHEN value > 5 THEN 'ok' ELSE 'failed' END AS result, count(*) AS n FROM events GROUP BY CUBE (1, 2)".replace("CUBE (1, 2)", "CUBE (event_type, CASE WHEN value IS NULL THEN 'none' WHEN value > 5 THEN 'ok' ELSE 'failed' END)"))
def activity_cube(spark, sf):
    """Counts by stage and result, and all their totals."""
    result = F.when(col("value").isNull(), "none").when(col("value") > 5, "ok").otherwise("failed")
    return table(spark, sf, "events").withColumn("result", result).cube("event_type", "result").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def event_history(spark, sf):
    """The last thousand events."""
    return table(spark, sf, "events").orderBy(F.desc("event_id")).limit(1000).select("event_id", "event_type")


@query("SELECT user_id, arg_max(event_type, n) AS most, max(n) AS n FROM (SELECT user_id, event_type, count(*) * 10 + CASE event_type WHEN 'click' THEN 5 WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def user_models(spark, sf):
    """The most frequent kind of event of each user; ties go by name."""
    place = F.expr("case event_type when 'click' then 5 when 'error' then 4 when 'purchase' then 3 when 'signup' then 2 else 1 end")
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg((F.count("*") * 10).alias("n")).withColumn("n", col("n") + place)
    return n.groupBy("user_id").agg(F.max_by("event_type", "n").alias("most"), F.max("n").alias("n"))


@query("SELECT conv_id, turn, upto FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM conversations) WHERE upto <= 400".replace("upto FROM (", "upto::BIGINT AS upto FROM ("))
def context_budget(spark, sf):
    """The newest turns of each conversation that fit a budget of 400 characters."""
    upto = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf, "conversations").withColumn("upto", upto).where("upto <= 400").select("conv_id", "turn", "upto")


@query(f"SELECT d.doc_id, b.i AS batch, (('0x' || substr(sha256('42:' || b.i || ':' || d.doc_id), 1, 6))::BIGINT % greatest(n_chars - 64, 1))::BIGINT AS start FROM documents d, (SELECT unnest(range(3)) AS i) b WHERE n_chars > 64")
def batch_windows(spark, sf):
    """Three seeded windows of 64 tokens in each document, by a hash."""
    d = table(spark, sf, "documents").where("n_chars > 64").select("doc_id", "n_chars", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("batch"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("42"), "batch", "doc_id"), 256), 1, 6), 16, 10).cast("long")
    return d.select("doc_id", "batch", (h % F.greatest(col("n_chars") - 64, F.lit(1))).alias("start"))
