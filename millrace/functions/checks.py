"""Guards, validators, drafts against evidence, claims, routing and scoring: column expressions over short texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.cleaners import strip

# Fixed values.
INJECTIONS = (
    "(?i)ignore\\s+(?:all|any|previous|prior)\\s+(?:instructions|rules|prompts?)",
    "(?i)disregard\\s+(?:the\\s+)?(?:system|safety)\\s+(?:prompt|rules|instructions)",
    "(?i)reveal\\s+(?:your\\s+)?(?:system\\s+prompt|instructions|context)",
    "(?i)you\\s+are\\s+now\\s+(?:dan|developer\\s+mode|jailbroken|uncensored)",
    "(?i)\\bjailbreak\\b",
    "(?i)act\\s+as\\s+if\\s+you\\s+have\\s+no\\s+(?:restrictions|rules|guidelines)",
    "(?i)pretend\\s+(?:you\\s+are|to\\s+be)\\s+an?\\s+(?:ai|llm|model)\\s+without",
    "(?i)do\\s+anything\\s+now|dan\\s+mode",
    "(?i)bypass\\s+(?:safety|guardrail|filter|restriction)",
    "(?i)override\\s+(?:your\\s+)?(?:training|instructions|programming)",
    "(?i)forget\\s+(?:all\\s+)?(?:your\\s+)?(?:instructions|rules|guidelines)",
    "(?i)from\\s+now\\s+on\\s+you\\s+(?:are|will|must|should)\\s+(?:always\\s+)?(?:ignore|bypass)",
)
UNSAFE_CODE = ("(?i)\\b(rm\\s+-rf|shutil\\.rmtree|os\\.remove.*\\*)\\b", "(?i)\\beval\\s*\\(.*exec\\s*\\(", "(?i)\\bsubprocess\\.(call|run|Popen).*shell\\s*=\\s*True", "(?i)__import__\\s*\\(\\s*['\"]os['\"]")
MAIL, SOCIAL = "\\b[\\w.+\\-]+@[\\w\\-]+\\.[\\w.]+\\b", "\\b\\d{3}-\\d{2}-\\d{4}\\b"
PLACEHOLDERS = (
    (MAIL, "[email]"),
    (SOCIAL, "[ssn]"),
    ("\\b\\d{4}[\\s\\-]\\d{4}[\\s\\-]\\d{4}[\\s\\-]\\d{4}\\b", "[card]"),
    ("\\b\\+?1?[\\s.]?\\(?\\d{3}\\)?[\\s.\\-]\\d{3}[\\s.\\-]\\d{4}\\b", "[phone]"),
    ("\\b\\d{4}\\s?\\d{4}\\s?\\d{4}\\s?\\d{4}\\b", "[card]"),
)
#: Secrets in output: what stands before a first = stays.
OUTPUT_SECRETS = (
    ("(?i)((?:api[_\\-]?key|secret|password|token|passwd|auth)\\s*)=\\s*\\S+", "$1=[REDACTED]"),
    ("(?i)((?:api[_\\-]?key|secret|password|token|passwd|auth)\\s*:\\s*[^\\s=]+)=\\S*", "$1=[REDACTED]"),
    ("(?i)(?:api[_\\-]?key|secret|password|token|passwd|auth)\\s*:\\s*[^\\s=]+(\\s|$)", "[REDACTED]$1"),
    ("sk-[A-Za-z0-9]{20,}", "[REDACTED]"),
    ("ghp_[A-Za-z0-9]{36}", "[REDACTED]"),
    ("xoxb-[0-9A-Za-z\\-]+", "[REDACTED]"),
    ("(Bearer\\s+[A-Za-z0-9\\-_.~+/]+)=+", "$1=[REDACTED]"),
    ("Bearer\\s+[A-Za-z0-9\\-_.~+/]+(\\s|$)", "[REDACTED]$1"),
)
EXPORT_SECRET = "(?i)(api[_\\-]?key|password|token)\\s*[:=]\\s*\\S+"
EXTENSIONS = (".pdf", ".docx", ".txt", ".md", ".csv", ".xlsx", ".png", ".jpg", ".jpeg", ".json", ".py", ".yaml", ".toml", ".log")
VOCABULARIES = {
    "reasoning": "(?i)\\b(?:therefore|because|since|thus|if|then|implies|conclude|reason|proof|derive|follows that|given that|suppose|assume|consequently|hence|although|however|nevertheless)\\b",
    "instruction": "(?i)\\b(?:how to|steps?|first|second|next|finally|procedure|method|example|solution|answer|question|explain|describe)\\b",
    "technical": "(?i)\\b(?:algorithm|function|class|module|API|parameter|variable|equation|theorem|proof|model|architecture|network|gradient|vector|matrix|tensor|hypothesis|experiment|dataset|entropy)\\b",
    "emotion": "(?i)\\b(?:emotion|feeling|mood|affect|anxiety|joy|grief|anger|fear|empathy|cognition|motivation|behaviour|psychology|mental|emotional|cognitive|perception|attention|memory|learning)\\b",
    "retrieval": "(?i)\\b(?:according to|source|evidence|passage|document|reference|states?|mentions?|cites?|found in|based on|retrieval|query)\\b",
    "kg": "(?i)\\b(?:is a|has a|consists? of|part of|related to|defined as|entity|concept|relation|triple|property|instance of|taxonomy)\\b",
    "teaching": "(?i)\\b(?:learn|understand|concept|explains?|teaches?|lesson|student|curriculum|knowledge|skill|comprehension|pedagogy)\\b",
}
#: A category's relevance: a constant, shares of vocabulary densities, and what a "<user>" in the text adds.
RELEVANCE = {
    "A": (0.8, {}, 0.0),
    "B": (0.0, {"instruction": 1.0}, 0.0),
    "C": (0.0, {"reasoning": 0.6, "technical": 0.4}, 0.0),
    "D": (0.0, {"instruction": 0.7}, 0.3),
    "E": (0.0, {"technical": 1.0}, 0.0),
    "F": (0.7, {}, 0.0),
    "G": (0.0, {"technical": 0.5, "reasoning": 0.5}, 0.0),
    "H": (0.8, {}, 0.0),
    "I": (0.0, {"emotion": 0.6, "teaching": 0.4}, 0.0),
    "J": (0.0, {"retrieval": 1.0}, 0.0),
    "K": (0.0, {"kg": 1.0}, 0.0),
}
ROUTES = (
    ("calculate", "(?i)^(calc|calculate|compute|what\\s+is\\s+\\d|evaluate)\\b"),
    ("code", "(?i)\\b(run|execute)\\s+(this\\s+)?(python|code|script)\\b"),
    ("remember", "(?i)^(remember|note\\s+that|save\\s+this|memo|don'?t\\s+forget)\\b"),
    ("recall_profile", "(?i)\\b(what\\s+do\\s+you\\s+know\\s+about\\s+me|my\\s+(preferences?|profile|settings?|style))\\b"),
    ("search_files", "(?i)\\b(find|search)\\s+(a\\s+|my\\s+|the\\s+)?(file|document|pdf|doc)\\b"),
    ("goal_command", "(?i)^/goal\\b"),
    ("kg_query", "(?i)^(who|what|where|when)\\s+.{3,40}\\?$"),
    ("workflow", "(?i)^(run\\s+workflow|execute\\s+task|agent:|start\\s+task)\\b"),
    ("ingest", "(?i)\\b(ingest|index|upload|add\\s+document|load\\s+file)\\b"),
    ("goal_add", "(?i)\\b(add\\s+goal|set\\s+goal|new\\s+goal|create\\s+goal)\\b"),
    ("goal_list", "(?i)\\b(show\\s+(my\\s+)?goals?|list\\s+goals?|what\\s+are\\s+my\\s+goals?)\\b"),
    ("memory_list", "(?i)\\b(show\\s+(my\\s+)?memories?|list\\s+memories?|what\\s+do\\s+you\\s+remember)\\b"),
    ("eval", "(?i)^(run\\s+eval|evaluate\\s+model|run\\s+evaluation)\\b"),
    ("metrics", "(?i)^(show\\s+metrics?|system\\s+status|observability)\\b"),
    ("teach", "(?i)\\b(teach\\s+me|explain\\s+step\\s+by\\s+step|quiz\\s+me|lesson)\\b"),
)
INTENTS = {
    "learning": ("teacher", "(?i)\\b(learn|study|understand|teach|explain|how does|what is|tutorial|guide)\\b"),
    "research": ("researcher", "(?i)\\b(research|investigate|analyze|find|search|evidence|sources|compare)\\b"),
    "planning": ("mentor", "(?i)\\b(plan|schedule|organize|roadmap|timeline|steps|agenda|next steps)\\b"),
    "decision": ("coach", "(?i)\\b(decide|choose|should I|which|best option|recommendation|pros and cons)\\b"),
    "coding": ("engineer", "(?i)\\b(code|program|function|bug|debug|implement|script|class|api|error)\\b"),
    "writing": ("assistant", "(?i)\\b(write|draft|essay|report|summarize|compose|document|article|email)\\b"),
    "support": ("supportive", "(?i)\\b(help|support|problem|issue|not working|broken|fix|error|trouble)\\b"),
    "exploration": ("mentor", "(?i)\\b(tell me|curious|wonder|explore|ideas|brainstorm|what if|possibilities)\\b"),
}
EMOTIONS = {
    "frustration": ("patient", ("frustrat", "annoy", "ugh", "wrong", "not working", "broken", "stuck")),
    "confusion": ("clear", ("confus", "don't understand", "unclear", "what does", "huh", "?")),
    "curiosity": ("engaged", ("how does", "why", "what is", "explain", "tell me", "curious")),
    "excitement": ("energetic", ("amazing", "love", "great", "awesome", "fantastic", "can't wait")),
    "sadness": ("warm", ("sad", "unfortunately", "fail", "disappoint", "sorry", "wrong")),
    "anger": ("calm", ("angry", "terrible", "worst", "useless", "nonsense", "hate")),
}
REASONING = {
    "factual": "(?i)\\b(what is|who is|when did|where is|define|meaning of)\\b",
    "comparative": "(?i)\\b(compare|difference|vs\\.?|versus|better|worse|pros and cons)\\b",
    "causal": "(?i)\\b(why|cause|reason|because|leads to|results in|due to)\\b",
    "procedural": "(?i)\\b(how to|steps to|how do I|procedure|process|implement|build)\\b",
    "evaluative": "(?i)\\b(should I|is it|evaluate|assess|worth|recommend|best)\\b",
    "hypothetical": "(?i)\\b(what if|suppose|imagine|if .* then|scenario|would)\\b",
    "summarization": "(?i)\\b(summarize|summarise|overview|tldr|brief|main points|key points)\\b",
    "creative": "(?i)\\b(write|draft|generate|create|design|brainstorm|suggest)\\b",
}
EVIDENCE_NEEDED = {"factual": 1, "comparative": 2, "causal": 2, "procedural": 1, "evaluative": 2, "hypothetical": 1, "summarization": 1, "creative": 0}
LEVELS = (
    ("expert", ("formal proof", "complexity", "benchmark", "cutting edge")),
    ("advanced", ("optimize", "internals", "architecture", "design", "trade-off")),
    ("intermediate", ("how does", "why does", "compare", "difference", "implement")),
    ("beginner", ("what is", "how do i", "explain", "basic", "simple", "start")),
)
GAPS = ("(?i)what (?:is|are|does?) (.{3,50})\\?", "(?i)don'?t understand (.{3,50})", "(?i)confused about (.{3,50})", "(?i)how (?:do|does|can) (.{3,50})\\?")
COPULAS = (("is", "(?:is\\s+not|isn'?t|is\\s+never)"), ("are", "(?:are\\s+not|aren'?t|are\\s+never)"), ("was", "(?:was\\s+not|wasn'?t|was\\s+never)"), ("were", "(?:were\\s+not|weren'?t|were\\s+never)"))
PHRASE = "([a-z][a-z0-9_\\- ]{2,40})"
EVIDENCE_STOP = (
    "the and for with that this from are was were has have had you your our their his her its not but any all some one two into onto over under than then there these those them they "
    "will would could should may might can cannot about which what when where why how who answer question based evidence limited confidence best supported supporting memory document knowledge graph using used available"
).split()
FALLBACKS = ("don't have enough information", "evidence is too thin", "insufficient evidence", "best-effort")
BOILERPLATE = "(?i)^(?:limited-confidence answer:\\s*)?(?:best supported answer from [a-z0-9_./-]+:\\s*)?"
CLAIM_STOP = (
    "a an the and or but is are was were be been to in on at for from with by as of when while this that it best supported answer limited confidence evidence available before after config memory knowledge graph help_center engine py generator inference"
).split()
PREDICATES = (
    ("pauses", "\\b(?:pauses?|paused)\\b"),
    ("completes", "\\b(?:completes?|completed)\\b"),
    ("clears", "\\b(?:clears?|clear|removes?|remove)\\b"),
    ("uses", "\\b(?:falls? back to|fallback)\\b"),
    ("uses", "\\b(?:uses?|via|through|with)\\b"),
    ("invokes", "\\b(?:invokes?|invoke|runs?|run|find|search)\\b"),
    ("equals", "\\b(?:equals?|is|=)\\b"),
)
NONE = "cast(array() as array<string>)"


def any_of(text: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def cases(pairs, default: Column) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(list(pairs)), default)


# --- guards ---


def input_block(text: Column, most: int = 50_000) -> Column:
    """Why an input is blocked; '' where it isn't."""
    return cases([(F.coalesce(strip(text), F.lit("")) == "", F.lit("empty input")), (F.length(text) > most, F.lit("input too long")), (any_of(text, INJECTIONS), F.lit("possible prompt injection detected"))], F.lit(""))


def memory_block(text: Column, most: int = 10_000) -> Column:
    return cases([(F.length(text) > most, F.lit("memory entry too long")), (any_of(text, INJECTIONS[:4]), F.lit("injection pattern in memory write rejected"))], F.lit(""))


def tool_block(tool: Column, code: Column, path: Column) -> Column:
    return cases([(tool.isin("code_exec", "python_exec") & any_of(code, UNSAFE_CODE), F.lit("unsafe code pattern")), (tool.isin("file_write", "save_file") & path.contains(".."), F.lit("path traversal"))], F.lit(""))


def file_block(path: Column, size: Column, most_mb: int = 100) -> Column:
    suffix = F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))
    return cases([(~suffix.isin(*EXTENSIONS), F.concat(F.lit("file type "), suffix, F.lit(" not allowed"))), (size > most_mb * 1024 * 1024, F.lit("file too large")), (path.contains(".."), F.lit("path traversal"))], F.lit(""))


def safe_output(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), (*OUTPUT_SECRETS, *PLACEHOLDERS), text)


def redact_export(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, "[REDACTED]"), (MAIL, SOCIAL, EXPORT_SECRET), text)


def pair_ok(prompt: Column, response: Column) -> Column:
    """A prompt of 3 words, a response of 5, a quarter of all words distinct."""
    both = X.words(F.lower(F.concat(prompt, F.lit(" "), response)))
    return (F.size(X.words(prompt)) >= 3) & (F.size(X.words(response)) >= 5) & (F.size(F.array_distinct(both)) / F.size(both) >= 0.25)


# --- routing and scoring ---


def route(text: Column) -> Column:
    return cases([(strip(text).rlike(p), F.lit(name)) for name, p in ROUTES], F.lit("chat"))


def first_best(scores: dict[str, Column], default: str, least: float) -> Column:
    """The first key with the highest score; the default where that is under `least`."""
    most = F.greatest(*scores.values())
    return cases([(most < least, F.lit(default))] + [(v == most, F.lit(k)) for k, v in scores.items()], F.lit(default))


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def intent(text: Column) -> Column:
    """struct(intent, persona, confidence)."""
    scores = {k: F.least(F.lit(1.0), hits(text, p) * 0.35) for k, (_, p) in INTENTS.items()}
    best = first_best(scores, "exploration", 0.2)
    persona = F.element_at(F.create_map(*[F.lit(x) for k, (who, _) in INTENTS.items() for x in (k, who)]), best)
    return F.struct(best.alias("intent"), persona.alias("persona"), F.round(F.greatest(*scores.values()), 3).alias("confidence"))


def emotion(text: Column) -> Column:
    """struct(emotion, tone, confidence) by keywords."""
    low = F.lower(text)
    scores = {k: F.least(F.lit(0.95), reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]) * 0.3) for k, (_, words) in EMOTIONS.items()}
    best = first_best(scores, "neutral", 0.0001)
    tone = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, (t, _) in EMOTIONS.items() for x in (k, t)]), best), F.lit("standard"))
    return F.struct(best.alias("emotion"), tone.alias("tone"), F.round(F.greatest(*scores.values()), 3).alias("confidence"))


def emotions(text: Column, top: int = 3) -> Column:
    """The emotions with most of their keywords, best first, as an array of (emotion, score)."""
    low = F.lower(text)
    found = [F.struct((-reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]) / len(words)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, (_, words)) in enumerate(EMOTIONS.items())]
    ranked = F.slice(F.array_sort(F.filter(F.array(*found), lambda x: x["s"] < 0)), 1, top)
    return F.when(F.size(ranked) > 0, F.transform(ranked, lambda x: F.struct(x["k"].alias("emotion"), F.round(-x["s"], 4).alias("score")))).otherwise(F.array(F.struct(F.lit("neutral").alias("emotion"), F.lit(1.0).alias("score"))))


def reasoning_type(query: Column) -> Column:
    return first_best({k: hits(query, p) for k, p in REASONING.items()}, "factual", 1)


def level(text: Column) -> Column:
    low = F.lower(text)
    return cases([(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(k)) for k, words in LEVELS], F.lit("intermediate"))


def gaps(text: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in GAPS])
    return F.slice(F.transform(found, strip), 1, 5)


def word_hits(text: Column, pattern: str) -> Column:
    """`hits` of a pattern of whole words (?:a|b|..), in either case: only words that begin as one of its own does are tried."""
    body = pattern.removeprefix("(?i)\\b(?:").removesuffix(")\\b")
    heads = "".join(sorted({w[0].lower() for w in body.split("|")}))
    return hits(text, f"(?i)\\b(?=[{heads}])(?:{body})\\b")


def densities(text: Column, n: Column) -> Column:
    """Struct of each vocabulary's density in a text of n words, and `tagged`, whether a "<user>" is in it."""
    each = {v: F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), word_hits(text, p) / F.greatest(F.lit(1.0), n / 10))) for v, p in VOCABULARIES.items()}
    return F.struct(*[d.alias(v) for v, d in each.items()], text.contains("<user>").alias("tagged"))


def relevance(found: Column, category: Column) -> Column:
    """How well a text of these `densities` fits its category; 0.5 where that isn't known."""
    made = []
    for letter, (constant, shares, tagged) in RELEVANCE.items():
        v = reduce(lambda a, kv: a + found[kv[0]] * kv[1], shares.items(), F.lit(constant))
        made.append((category == letter, v + F.when(found["tagged"], tagged).otherwise(0.0) if tagged else v))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cases(made, F.lit(0.5)))), 4)


# --- responses against evidence ---


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), 0))


def covered(query: Column, text: Column) -> Column:
    """Share of the query's words of three letters or more in the text."""
    q = long_words(query)
    return F.size(F.array_intersect(q, long_words(text))) / F.greatest(F.size(q), F.lit(1))


def _result(passed: Column, score: Column) -> Column:
    return F.struct(passed.alias("passed"), score.cast("double").alias("score"))


def facts_check(response: Column, texts: Column, bar: float = 0.7) -> Column:
    claims = F.regexp_extract_all(response, F.lit("\\b[A-Z][a-zA-Z]{2,}(?:\\s+[a-z]+){0,3}"), 0)
    evidence = F.lower(F.array_join(F.slice(texts, 1, 5), " "))
    score = F.size(F.filter(claims, lambda c: F.contains(evidence, F.lower(c)))) / F.size(claims)
    return F.when(F.size(claims) == 0, _result(F.lit(True), F.lit(1.0))).otherwise(_result(score >= bar, score))


def citations_check(response: Column, sources: Column) -> Column:
    cited = F.regexp_extract_all(response, F.lit("\\[([^\\]]{2,40})\\]"), 1)
    low = F.transform(sources, F.lower)
    held = F.filter(cited, lambda c: F.exists(low, lambda s: F.contains(s, F.lower(c)) | F.contains(F.lower(c), s)))
    score = F.size(held) / F.size(cited)
    return F.when(F.size(cited) == 0, _result(F.lit(True), F.lit(1.0))).otherwise(_result(score >= 0.5, score))


def kg_check(response: Column, subjects: Column) -> Column:
    """subjects: those the graph contradicts itself about."""
    bad = F.exists(subjects, lambda s: F.contains(F.lower(response), s))
    return F.when(bad, _result(F.lit(False), F.lit(0.5))).otherwise(_result(F.lit(True), F.lit(1.0)))


def memory_check(response: Column, memories: Column) -> Column:
    phrases = F.flatten(F.transform(F.slice(memories, 1, 5), lambda m: F.slice(F.regexp_extract_all(F.lower(m), F.lit("[a-z]{3,}\\s+is\\s+[a-z]{3,}"), 0), 1, 2)))
    n = F.size(F.filter(phrases, lambda p: F.contains(F.lower(response), F.replace(p, F.lit(" is "), F.lit(" is not ")))))
    return F.when(n > 0, _result(F.lit(False), F.greatest(F.lit(0.3), 1.0 - 0.2 * n))).otherwise(_result(F.lit(True), F.lit(1.0)))


def reasoning_check(response: Column, query: Column, issues: Column) -> Column:
    c = covered(query, response)
    return _result(c >= 0.25, F.round(c * F.when(issues > 0, 0.8).otherwise(1.0), 3))


def output_check(response: Column) -> Column:
    leaks = any_of(response, (MAIL, SOCIAL, EXPORT_SECRET))
    return F.when(leaks, _result(F.lit(False), F.lit(0.2))).otherwise(_result(F.lit(True), F.lit(1.0)))


def verdict(checks: list[Column]) -> Column:
    """struct(passed, score, warn, block) of several checks."""
    passed, score = reduce(lambda a, b: a & b, [c["passed"] for c in checks]), reduce(lambda a, b: a + b, [c["score"] for c in checks]) / len(checks)
    return F.struct(passed.alias("passed"), F.round(score, 3).alias("score"), (~passed & (score >= 0.5)).alias("warn"), (score < 0.2).alias("block"))


def verified(query: Column, texts: Column, kind: Column, confidence: Column) -> Column:
    """struct(coverage, verified, issues, gaps) of evidence for a kind of reasoning."""
    needed = cases([(kind == k, F.lit(n)) for k, n in EVIDENCE_NEEDED.items()], F.lit(1))
    c = covered(query, F.array_join(texts, " "))
    issues = (F.size(texts) < needed).cast("int") + (confidence < 0.35).cast("int")
    return F.struct(F.round(c, 3).alias("coverage"), (issues == 0).alias("verified"), issues.alias("issues"), (c < 0.3).cast("int").alias("gaps"))


def confidence_of(evidence: Column, check: Column, cognition: Column) -> Column:
    raw = 0.4 * evidence + 0.3 * check["coverage"] + 0.2 * F.when(check["verified"], 1.0).otherwise(0.5) + 0.1 * cognition
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 3)


def strength(evidence: Column, n: Column, coverage: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), evidence * 0.6 + F.least(n.cast("double"), F.lit(4.0)) / 4.0 * 0.2 + coverage * 0.2)), 4)


def judged(response: Column, texts: Column) -> Column:
    """struct(score, faithfulness, consistency, citation) by overlap, length and citations."""
    r, e = long_words(response), long_words(F.array_join(texts, " "))
    faith = F.when(F.size(e) == 0, 0.5).otherwise(F.size(F.array_intersect(r, e)) / F.greatest(F.size(r), F.lit(1)))
    even = F.least(F.size(X.words(response)) / 50, F.lit(1.0))
    n = F.size(F.regexp_extract_all(response, F.lit("\\[([^\\]]{2,40})\\]"), 1))
    cites = F.when(n == 0, 0.5).otherwise(F.least(n / 3, F.lit(1.0)))
    return F.struct(F.round(0.4 * faith + 0.3 * even + 0.3 * cites, 3).alias("score"), F.round(faith, 3).alias("faithfulness"), F.round(even, 3).alias("consistency"), F.round(cites, 3).alias("citation"))


# --- drafts ---


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("-?\\d+(?:\\.\\d+)?"), 0)


def content_tokens(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9_\\-]{2,}"), 0), F.lower)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*EVIDENCE_STOP)))


def negation_flip(draft: Column, evidence: Column) -> Column:
    """The draft says of some subject what the evidence denies, or denies what it says."""
    d, e = F.lower(draft), F.lower(evidence)

    def flipped(here: str, there: str) -> Column:
        pattern = F.lit(f"\\b{PHRASE}\\s+{here}\\s+{PHRASE}")
        pairs = F.zip_with(F.regexp_extract_all(e, pattern, 1), F.regexp_extract_all(e, pattern, 2), lambda s, o: F.struct(strip(s).alias("s"), strip(o).alias("o")))
        said = lambda p: F.concat(F.lit("\\b\\Q"), p["s"], F.lit(f"\\E\\s+{there}\\s+\\Q"), p["o"], F.lit("\\E\\b"))
        return F.exists(pairs, lambda p: (p["s"] != "") & (p["o"] != "") & F.rlike(d, said(p)))

    return reduce(lambda a, b: a | b, [flipped(a, b) for yes, no in COPULAS for a, b in ((yes, no), (no, yes))])


def numeric_contradiction(draft: Column, evidence: Column) -> Column:
    """A number of the draft stands where a sentence of the evidence on the same subject has another.

    The subject is what the evidence holds of the last four content tokens in the
    80 characters before the number.
    """
    d, e = F.lower(draft), F.lower(evidence)
    sentences = F.split(e, "(?<=[.!?])\\s+|\\n+")
    nums = numbers(d)
    parts = F.split(d, "-?\\d+(?:\\.\\d+)?")  # the text before the k-th number: the parts up to it and the numbers between

    def clash(k: Column) -> Column:
        upto = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), k), lambda j: F.concat(F.get(parts, j), F.when(j < k, F.get(nums, j)).otherwise(F.lit("")))), ""))
        window = F.when(F.length(upto) > 80, F.substring(upto, -80, 80)).otherwise(upto)
        tokens = F.filter(F.regexp_extract_all(window, F.lit("[A-Za-z][A-Za-z0-9_\\-]{2,}"), 0), lambda t: ~t.isin(*EVIDENCE_STOP))
        last = F.filter(F.when(F.size(tokens) > 4, F.slice(tokens, -4, 4)).otherwise(tokens), lambda t: F.contains(e, t))
        other = lambda s: F.exists(numbers(s), lambda n: n != F.get(nums, k))
        return F.exists(sentences, lambda s: F.exists(last, lambda t: F.contains(s, t)) & other(s))

    return F.when(F.size(nums) == 0, False).otherwise(F.exists(F.sequence(F.lit(0), F.greatest(F.size(nums) - 1, F.lit(0))), clash))


def missed_evidence(query: Column, draft: Column, evidence: Column) -> Column:
    asked = F.array_except(content_tokens(query), content_tokens(draft))
    return F.exists(asked, lambda t: (F.length(F.lower(evidence)) - F.length(F.replace(F.lower(evidence), t, F.lit("")))) / F.length(t) >= 2)


def unsupported_claim(draft: Column, evidence: Column) -> Column:
    return F.exists(numbers(draft), lambda n: ~F.contains(F.lower(evidence), n))


def draft_problem(query: Column, draft: Column, evidence: Column) -> Column:
    """The first of contradiction, missed_evidence and unsupported_claim; '' where there is none."""
    blank = (strip(draft) == "") | (strip(evidence) == "")
    return cases([(blank, F.lit("")), (numeric_contradiction(draft, evidence) | negation_flip(draft, evidence), F.lit("contradiction")), (missed_evidence(query, draft, evidence), F.lit("missed_evidence")), (unsupported_claim(draft, evidence), F.lit("unsupported_claim"))], F.lit(""))


# --- claims ---


def claim(answer: Column) -> Column:
    """struct(subject, predicate, object, numbers, negation, key, tokens) of an answer."""
    core = lambda low: F.regexp_replace(strip(F.regexp_replace(low, BOILERPLATE, "")), "\\s+", " ")
    tokens = lambda core: F.filter(F.regexp_extract_all(core, F.lit("[a-z0-9_]+"), 0), lambda t: ~t.isin(*CLAIM_STOP) & (F.length(t) > 1))
    numbers = lambda core: F.regexp_extract_all(core, F.lit("\\b\\d+(?:\\.\\d+)?\\b"), 0)
    parts = X.let(F.lower(strip(answer)), lambda low: X.let(core(low), lambda c: F.struct(low.alias("low"), c.alias("core"), tokens(c).alias("tok"), numbers(c).alias("nums"))))
    return X.let(parts, lambda p: X.let(_claim_subject(p), lambda s: X.let(_claim_predicate(p), lambda v: X.let(_claim_object(p, s, v), lambda o: _claim(p, s, v, o)))))


def _holds(core: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [core.contains(x) for x in words])


def _claim_subject(p: Column) -> Column:
    has = lambda *w: _holds(p["core"], *w)
    return cases(
        [
            (has("top_k", "top k"), F.lit("top_k")),
            (has("final_k", "final k"), F.lit("final_k")),
            (has("clear_session"), F.lit("clear_session")),
            (has("password") & has("reset"), F.lit("password_reset")),
            (has("grounded fallback", "checkpoint"), F.lit("model_fallback")),
            (has("goal split") | (has("goal") & has("parent")), F.lit("goal_split")),
            (has("document") & has("search", "find"), F.lit("document_search")),
            (F.size(p["tok"]) > 0, F.get(p["tok"], F.lit(0))),
        ],
        F.lit("unknown"),
    )


def _claim_predicate(p: Column) -> Column:
    return cases([(p["core"].rlike(x), F.lit(k)) for k, x in PREDICATES], F.lit("asserts"))


def _claim_object(p: Column, subject: Column, predicate: Column) -> Column:
    has = lambda *w: _holds(p["core"], *w)
    rest = F.filter(p["tok"], lambda t: (t != subject) & (t != predicate))
    return cases(
        [
            (F.size(p["nums"]) > 0, F.get(p["nums"], F.lit(0))),
            (subject == "password_reset", F.when(has("email", "link"), "email_reset_link").otherwise("password_reset_flow")),
            (subject == "model_fallback", F.when(has("grounded fallback"), "grounded_fallback").otherwise("model_unavailable")),
            (subject == "clear_session", F.lit("session_history")),
            (subject == "document_search", F.when(has("find"), "find_document").otherwise("document_search")),
            (subject == "goal_split", F.lit("parent")),
            (F.size(rest) > 0, F.element_at(rest, -1)),
        ],
        F.lit("unknown"),
    )


def _claim(p: Column, subject: Column, predicate: Column, object_: Column) -> Column:
    thin = _holds(p["low"], *FALLBACKS)
    key = F.concat_ws("::", subject, predicate, F.when(F.size(p["nums"]) > 0, F.array_join(p["nums"], "|")).otherwise(object_))
    empty = F.expr(NONE)
    return F.struct(
        F.when(thin, "").otherwise(subject).alias("subject"),
        F.when(thin, "fallback").otherwise(predicate).alias("predicate"),
        F.when(thin, "insufficient_evidence").otherwise(object_).alias("object"),
        F.when(thin, empty).otherwise(p["nums"]).alias("numbers"),
        thin.alias("negation"),
        F.when(thin, "fallback::insufficient_evidence").otherwise(key).alias("key"),
        F.when(thin, empty).otherwise(F.array_distinct(p["tok"])).alias("tokens"),
    )


def claims_agree(a: Column, b: Column) -> Column:
    """From 0 to 1: how far two claims say the same."""
    both = F.size(F.array_intersect(a["tokens"], b["tokens"]))
    overlap = both / F.greatest(F.size(F.array_union(a["tokens"], b["tokens"])), F.lit(1))
    numbered = (F.size(a["numbers"]) > 0) & (F.size(b["numbers"]) > 0)
    mixed = 0.5 * overlap + F.when(a["subject"] == b["subject"], 0.3).otherwise(0.0) + F.when(a["predicate"] == b["predicate"], 0.2).otherwise(0.0)
    return cases(
        [
            (a["negation"] & b["negation"], F.lit(1.0)),
            (a["negation"] != b["negation"], F.lit(0.0)),
            (numbered & (a["numbers"] != b["numbers"]), F.lit(0.0)),
            (a["key"] == b["key"], F.lit(1.0)),
            ((a["subject"] == b["subject"]) & numbered, F.lit(1.0)),
            ((a["subject"] == b["subject"]) & (a["predicate"] != b["predicate"]), F.lit(0.0)),
        ],
        F.round(mixed, 4),
    )
