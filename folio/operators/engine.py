"""Running a plan: filters and retrievers as one lineage of DataFrames; only the answer is collected.

A TenantCatalog hands out tables and the index of one tenant only, so every statistic, vocabulary and
result is the tenant's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.durable import materialize
from folio.functions import text as T
from folio.functions.stem import stem
from folio.operators import answers as A
from folio.operators import compute as C
from folio.operators import filters as O
from folio.operators import postings as P
from folio.operators import rank as R
from folio.operators import retrieve as V
from folio.operators.index import Index
from folio.operators.meaning import Retriever, Scorer, reranked
from folio.plans.packs import Domain
from folio.plans.plan import STRATEGIES, QueryPlan, identifier_only, plan_query, validate
from folio.sources.tables import table

SHARED_TABLES = ("unit_limits", "benchmark", "lang_samples")
# Match types that put a document into the set of a computation.
DOCUMENT_SET = ("exact_phrase", "exact_identifier", "exact_term", "joined_form", "partial_identifier", "all_terms", "ocr_tolerant", "filename", "filename_terms")
COMPUTED = ("count", "percentage", "group", "sum", "average", "min", "max", "lookup")
#: Evidence of a result, results that a lookup and a stated figure are taken from, words that may be corrected.
MOST_EVIDENCE, LOOKUP_RESULTS, FACT_RESULTS, MOST_CORRECTED = 3, 3, 5, 6
#: Confidence by tier; that of a match in meaning alone follows its similarity.
CONFIDENCE = {1: 0.97, 2: 0.85, 3: 0.6}
CANDIDATE = "document_id string, unit_id string, retriever string, match_type string, raw_score double, matched string, page int, char_start int, char_end int"


def _spelled(term: str) -> str:
    """A pattern of a term's words in a text, whatever stands between them."""
    return r"(?iu)(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(re.escape(w) for w in T.split_words(term) or [term])


class TenantCatalog:
    """Tables and index of one tenant, or with None those of the whole collection."""

    def __init__(self, spark: SparkSession, folder: str, tenant: str | None):
        self.spark, self.folder, self.tenant = spark, folder, tenant

    def table(self, name: str) -> DataFrame:
        df = table(self.spark, self.folder, name)
        return df if name in SHARED_TABLES or self.tenant is None else df.where(F.col("tenant_id") == F.lit(self.tenant))

    def units(self) -> DataFrame:
        return P.latest(self.table("units"), "unit_id", "stored_at")

    def index(self) -> Index:
        return Index.stored(self.spark, self.folder, self.units() if self.tenant is None else self.units().drop("tenant_id"), self.table("documents"), self.tenant)


class Engine:
    """Answers the questions of one tenant. fields: the tenant's facts, for amounts and dates; retrievers: further ones,
    run where the plan names them or knows no such name; scorer: puts the head of the results in order of relevance;
    domain: document types and concepts of merged packs."""

    def __init__(self, catalog: TenantCatalog, fields: DataFrame | None = None, retrievers: tuple[Retriever, ...] = (), scorer: Scorer | None = None, domain: Domain | None = None):
        self.catalog, self.fields, self.retrievers, self.scorer, self.domain = catalog, fields, retrievers, scorer, domain

    def plan(self, question: str, today: date | None = None) -> QueryPlan:
        """The validated plan; organisations of the tenant that a computation names become a condition."""
        types = self.domain.type_terms() if self.domain else {}
        plan = plan_query(question, today, types=types)
        if plan.intent in COMPUTED and plan.text:
            plan = plan_query(question, today, self.organizations(question), types)
        return validate(plan, types)

    def organizations(self, question: str) -> tuple[str, ...]:
        """Names of the tenant's organisations (without legal forms) that stand in the question: at most its word groups."""
        grams = T.question_ngrams(question)
        if not grams:
            return ()
        named = self.catalog.table("entities").where("type = 'organization'").select(T.norm_org(F.col("value_norm")).alias("name")).where(F.col("name").isin(grams)).distinct()
        names = sorted((r["name"] for r in named.collect()), key=len, reverse=True)
        return tuple(n for k, n in enumerate(names) if not any(f" {n} " in f" {longer} " for longer in names[:k]))

    def scope(self, plan: QueryPlan) -> DataFrame:
        """The documents that the plan's filters leave."""
        f, docs = plan.filters, O.indexed(self.catalog.table("documents"))
        docs = O.of_types(docs, f.doc_types, f.hard) if f.doc_types else docs
        docs = O.of_kinds(docs, f.kinds, f.extensions)
        if f.has_signature is not None:
            docs = O.signed(docs, f.has_signature)
        if f.signer:
            docs = O.signed_by(docs, self.catalog.table("entities"), f.signer)
        for party in f.parties:
            docs = O.with_party(docs, self.catalog.table("entities"), self.catalog.index().phrase(party), party)
        if f.clause_types:
            docs = O.with_clauses(docs, self.catalog.table("clauses"), f.clause_types)
        if self.fields is not None:
            for d in f.dates:
                docs = O.dated(docs, self.fields, d.start, d.end, d.field)
            for a in f.amounts:
                docs = O.of_amount(docs, self.fields, a.op, a.value, a.value2, a.currency)
            if f.jurisdictions:
                docs = O.in_jurisdictions(docs, self.fields, f.jurisdictions)
        return docs

    def candidates(self, plan: QueryPlan, strategies: list[str] | None = None) -> DataFrame:
        """CANDIDATE rows of the retrievers that the plan (or ``strategies``) names, in one union, inside the
        plan's filters. Scores are those of the whole tenant, whatever the filters. A semantic retriever needs an
        embedder and is one of the further ones."""
        chosen = strategies or plan.strategies or list(STRATEGIES)
        scope, index = self.scope(plan), self.catalog.index()
        parts: list[DataFrame] = [self.catalog.spark.createDataFrame([], CANDIDATE)]

        def add(found: DataFrame, retriever: str, match: str | None, matched: str = "", score: str | Column | None = None) -> None:
            raw = F.lit(1.0) if score is None else F.col(score) if isinstance(score, str) else score
            columns = set(found.columns)
            spans = [(F.col(c) if c in columns else F.lit(None)).cast("int").alias(c) for c in ("page", "char_start", "char_end")] if match in (None, "entity", "concept_clause") else [F.lit(None).cast("int").alias(c) for c in ("page", "char_start", "char_end")]
            unit = F.col("unit_id") if "unit_id" in columns else F.lit(None).cast("string")
            kind = F.col("match_type") if match is None else F.lit(match)
            parts.append(found.select("document_id", unit.alias("unit_id"), F.lit(retriever).alias("retriever"), kind.alias("match_type"), raw.cast("double").alias("raw_score"), F.lit(matched).alias("matched"), *spans))

        words = list(dict.fromkeys(plan.text.split()))
        forms = T.join_variants(words)
        held = index.known([w for t in (*plan.phrases, *words, *forms) for w in T.split_words(t)])

        def may_hold(text: str) -> bool:
            return all(w in held for w in T.split_words(text))

        if "exact" in chosen:
            for phrase in filter(may_hold, plan.phrases):
                add(index.phrase(phrase), "exact", "exact_phrase", phrase)
            for identifier in plan.identifiers:
                add(index.identifier(identifier), "exact", "exact_identifier", identifier)
            if len(words) == 1 and may_hold(plan.text):
                add(index.ranked(words), "exact", "exact_term", words[0], "score")
            if len(words) >= 2 and may_hold(plan.text):
                add(index.phrase(plan.text), "exact", "exact_phrase", plan.text)
            named = T.split_words(" ".join([*plan.phrases, plan.text]))
            named = [w for w in named if w not in T.STOPWORDS] or named
            if len("".join(named)) >= 3:
                files = self.catalog.table("documents").join(index.named(named), "document_id", "left_semi")
                found = V.filename(files, named)
                add(found.drop("unit_id"), "exact", None, " ".join(named), "raw_score")
        if "lexical" in chosen and len(words) >= 2:
            stems = sorted({stem(w) for w in words})
            need = max(2, -(-3 * len(stems) // 5)) if len(stems) >= 3 and not plan.phrases else len(stems)
            scored = index.ranked(stems, need, "s")
            add(scored.withColumn("match_type", F.when(F.col("matched") == len(stems), "all_terms").otherwise("most_terms")), "lexical", None, plan.text, "score")
            for form in filter(may_hold, forms):
                add(index.phrase(form), "lexical", "joined_form", form)
        if "fuzzy" in chosen and words:
            add(index.folded(plan.text.split()), "fuzzy", "ocr_tolerant", plan.text)
            for word in words:
                if V.is_part(word):
                    add(index.part(word), "fuzzy", "partial_identifier", word)
            wrong = [w for w in words if w not in held and len(w) >= 5 and not w.isdigit()] if len(words) <= MOST_CORRECTED else []
            meant = {c: w for w in wrong for c in index.corrections(w)}
            if meant:  # dropped by fuse where anything else is found
                add(index.ranked(words, same=meant), "fuzzy", "fuzzy", " ".join(meant), "score")
        if "entity" in chosen:
            add(V.entity(self.catalog.spark, self.catalog.table("entities"), plan.question).drop("unit_id"), "entity", "entity", "", "raw_score")
        if "contextual" in chosen:
            for _, kind, ways in V.concepts_of(plan.question, self.domain):
                add(self.catalog.table("clauses").where(F.col("clause_type") == kind), "contextual", "concept_clause", kind)
                for way in ways:
                    add(index.phrase(way), "contextual", "concept", way, F.lit(0.5))
        if "metadata" in chosen and words and may_hold(plan.text):
            whole = index.postings("w", words).groupBy("unit_id").agg(F.count("*").alias("n")).where(F.col("n") == len(words))
            add(index.text_of(whole).where("unit_type = 'document'"), "metadata", "metadata", plan.text)
        if not (words or plan.phrases or plan.identifiers) or plan.strategies == ["structured"]:
            add(scope, "structured", "structured", "", F.lit(0.0))
        parts += [r.retrieve(self, plan) for r in self.retrievers if r.name in chosen or r.name not in STRATEGIES]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.join(scope.select("document_id"), "document_id", "left_semi")

    def ranked(self, plan: QueryPlan, candidates: DataFrame, few: bool = False) -> DataFrame:
        """The candidates' documents in the order of the fusion rules."""
        f = plan.filters
        soft = self.catalog.table("documents").where(F.col("doc_type").isin(f.doc_types)) if f.doc_types and not f.hard else None
        words = [w for w in plan.text.split() if w not in T.STOPWORDS]
        ways = {w for name, _, said in V.concepts_of(plan.question, self.domain) for way in (name, *said) for w in way.split()}
        unmatched = bool(self.catalog.index().unknown([w for w in words if w not in ways])) if words and "contextual" in plan.strategies else False
        return R.fuse(candidates, plan.exact_intent, identifiers_only=identifier_only(plan), phrased=bool(plan.phrases), unmatched=unmatched, soft=soft, few=few)

    def evidence(self, plan: QueryPlan, candidates: DataFrame) -> DataFrame:
        """document_id, n, page, char_start, char_end, text, match_type, retriever: up to MOST_EVIDENCE items of each document,
        best matches first.

        What is said to match exactly is checked on the stored text and left out where it does not. Hits of a
        document's summary are shown by its first passage, those with a span by the page around it.
        """
        index = self.catalog.index()
        order = [R.tier(F.col("match_type")), R.priority(F.col("match_type")), F.desc("raw_score")]
        terms = T.highlight_terms(plan.phrases, plan.text)
        held = candidates.where("unit_id IS NOT NULL")
        texts = index.text_of(held).select("unit_id", "unit_type", F.col("page").alias("u_page"), F.col("char_start").alias("u_start"), "text")
        joined = F.concat(F.lit(" "), F.concat_ws(" ", T.tokens(F.col("text"))), F.lit(" "))
        proven = (
            F.when(F.col("match_type") == "exact_identifier", F.array_contains(T.identifiers(F.col("text")), F.col("matched")))
            .when(F.col("match_type").isin("exact_phrase", "exact_term"), joined.contains(F.concat(F.lit(" "), F.concat_ws(" ", T.tokens(F.col("matched"))), F.lit(" "))))
            .otherwise(True)
        )
        hits = held.drop("page", "char_start", "char_end").join(texts, "unit_id").where(proven)
        summaries = hits.where("unit_type = 'document'").select("document_id").distinct()
        first = Window.partitionBy("document_id").orderBy("ordinal", "unit_id")
        opening = index.units().where("unit_type = 'passage'").join(summaries, "document_id", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
        opening = opening.select("document_id", F.col("unit_id").alias("o_unit"), F.col("page").alias("o_page"), F.col("char_start").alias("o_start"), F.col("text").alias("o_text"))
        hits = hits.join(opening, "document_id", "left").withColumn("summary", F.col("unit_type") == "document")
        other = F.col("summary") & F.col("o_unit").isNotNull()
        for new, old in (("unit_id", "o_unit"), ("u_page", "o_page"), ("u_start", "o_start"), ("text", "o_text")):
            hits = hits.withColumn(new, F.when(other, F.col(old)).otherwise(F.col(new)))
        at = F.coalesce(*[F.nullif(F.regexp_instr("text", F.lit(_spelled(t))), F.lit(0)) for t in terms], F.lit(1))
        start, window = T.window_around(F.col("text"), at)
        shown = hits.select("document_id", "summary", "match_type", "retriever", "raw_score", F.col("unit_id").alias("key"), F.col("u_page").alias("page"), (F.col("u_start") + start).alias("char_start"), window.alias("text"))
        spans = candidates.where("unit_id IS NULL AND page IS NOT NULL AND char_start IS NOT NULL AND char_end IS NOT NULL")
        pages = self.catalog.table("pages").select("document_id", "page", F.col("text").alias("whole")).dropDuplicates(["document_id", "page"])
        begin = F.greatest(F.lit(0), F.col("char_start") - 60)
        around = spans.join(pages, ["document_id", "page"]).where(F.col("char_end") <= F.length("whole"))
        around = around.select(
            "document_id", F.lit(False).alias("summary"), "match_type", "retriever", "raw_score", F.concat_ws(":", F.col("page").cast("string"), F.col("char_start").cast("string")).alias("key"), "page", begin.alias("char_start"),
            F.substring("whole", begin + 1, F.greatest(F.lit(360), F.col("char_end") - begin)).alias("text"),
        )
        one = Window.partitionBy("document_id", "key").orderBy("summary", *order)
        every = shown.unionByName(around).withColumn("_k", F.row_number().over(one)).where("_k = 1")
        best = Window.partitionBy("document_id").orderBy("summary", *order, "key")
        every = every.withColumn("n", F.row_number().over(best)).where(F.col("n") <= MOST_EVIDENCE)
        return every.select("document_id", "n", "page", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "text", "match_type", "retriever")

    def search(self, plan: QueryPlan, limit: int = 20) -> DataFrame:
        """rank, document_id, filename, title, doc_type, tier, score, confidence, page, char_start, snippet, evidence of the best
        documents. One that matched through its text, but of which no evidence is proven, is left out."""
        candidates = materialize(self.candidates(plan))  # read several times
        ranked = materialize(self.ranked(plan, candidates, candidates.count() <= R.FEW).where(F.col("rank") <= 2 * limit))
        head = ranked  # twice as many, for some may be left out
        some = candidates.join(head.select("document_id"), "document_id", "left_semi")
        items = self.evidence(plan, some).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "page", "char_start", "char_end", "text", "match_type", "retriever"))).alias("evidence"))
        filtered = some.where("match_type = 'structured'").select("document_id", F.lit(True).alias("_filtered")).distinct()
        docs = O.indexed(self.catalog.table("documents")).select("document_id", "filename", "title", "doc_type")
        found = head.join(docs, "document_id").join(items, "document_id", "left").join(filtered, "document_id", "left").where("evidence IS NOT NULL OR _filtered")
        found = found.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).where(F.col("rank") <= limit)  # at most 2 * limit rows
        sure = F.coalesce(*[F.when(F.col("tier") == t, F.lit(c)) for t, c in CONFIDENCE.items()], F.round(F.least(F.lit(0.9), 0.4 + F.coalesce("vec", F.lit(0.0))), 2))
        first = F.col("evidence")[0]
        return found.select("rank", "document_id", "filename", "title", "doc_type", "tier", "score", sure.alias("confidence"), first["page"].alias("page"), first["char_start"].alias("char_start"), first["text"].alias("snippet"), "evidence").orderBy("rank")

    def lookup(self, plan: QueryPlan, limit: int = 20) -> DataFrame:
        """rank, document_id, value, confidence, n: the asked field of the best documents."""
        best = self.search(plan, LOOKUP_RESULTS).select("rank", "document_id")
        value = F.coalesce("value_text", F.col("value_date").cast("string"), F.col("value_num").cast("string"))
        return C.lookup(best, self.fields, plan.lookup_field, LOOKUP_RESULTS).select("rank", "document_id", value.alias("value"), "confidence", "n").orderBy("rank", "n")

    def fact(self, plan: QueryPlan) -> DataFrame:
        """document_id, page, value, unit, snippet: a figure that a top passage states for "how many X"; quoted, never computed."""
        noun = A.counted_noun(plan.question)
        items = self.search(plan, FACT_RESULTS).select("rank", "document_id", F.inline("evidence"))
        found = items.withColumn("value", A.stated_figure(F.col("text"), noun) if noun else F.lit(None).cast("string")).where("value IS NOT NULL")
        return found.orderBy("rank", "n").limit(1).select("document_id", "page", "value", F.lit(noun).alias("unit"), F.col("text").alias("snippet"))

    def document_set(self, plan: QueryPlan) -> DataFrame:
        """Documents of a computation: filters, and the words of the question where there are any. Only
        the matches of DOCUMENT_SET count, so not most words and no corrected typing errors."""
        scope = self.scope(plan)
        if not (plan.text or plan.phrases or plan.identifiers):
            return scope
        found = self.candidates(plan, ["exact", "lexical", "fuzzy"]).where(F.col("match_type").isin(*DOCUMENT_SET))
        return scope.join(found.select("document_id").distinct(), "document_id", "left_semi")

    def run(self, question: str, today: date | None = None, limit: int = 20) -> DataFrame:
        """The answer of a question as a DataFrame: results, a number, or a table."""
        return self.execute(self.plan(question, today), limit)

    def execute(self, plan: QueryPlan, limit: int = 20) -> DataFrame:
        if plan.intent == "lookup" and plan.lookup_field and self.fields is not None:
            return self.lookup(plan, limit)
        if plan.intent in ("search", "fact", "lookup"):
            found = self.search(plan, limit)
            return found if self.scorer is None else reranked(found, plan.question, self.scorer)
        scope = self.document_set(plan)
        name = plan.aggregate_field or "total_amount"
        if plan.compare and self.fields is not None:
            ranges = C.periods(self.catalog.spark, [(C.period_label(f.start, f.end), f.start, f.end) for f in plan.compare])
            if plan.intent == "count":
                return C.compare_counts(scope, self.fields, ranges)
            return C.compare_amounts(C.one_amount(scope, self.fields, name), self.fields, ranges, plan.intent)
        if plan.intent == "count":
            return C.count(scope)
        if plan.intent == "percentage":
            return C.percentage(scope, O.indexed(self.catalog.table("documents")))
        if plan.intent == "group":
            key = {"type": "doc_type", "language": "language", "status": "status"}.get(plan.group_by or "type")
            if key:
                return C.group_documents(scope, key).orderBy(F.desc("count"), "key")
            if plan.group_by in ("month", "year"):
                return C.group_dates(scope, self.fields, "yyyy-MM" if plan.group_by == "month" else "yyyy").orderBy("key")
            return C.group_values(scope, self.fields, "total_amount" if plan.group_by == "currency" else plan.group_by, "unit" if plan.group_by == "currency" else "value_text")
        return C.amounts(C.one_amount(scope, self.fields, name), plan.intent)

    def answer(self, question: str, today: date | None = None, model: Callable[[str, list[dict]], list[dict]] | None = None) -> dict:
        """A grounded answer. Computed questions are answered by their rows and never rewritten; others by quoted
        sentences, or by a model (question, evidence -> sentences with citations) whose sentences are verified."""
        plan = self.plan(question, today)
        if plan.intent in COMPUTED:
            rows = [r.asDict(True) for r in self.execute(plan).limit(C.MAX_RECORDS).collect()]
            if rows:
                return {"provider": "computation", "status": "computed", "rows": rows}
        if plan.intent == "fact" and (found := self.fact(plan).collect()):
            return {"provider": "computation", "status": "quoted", "rows": [found[0].asDict(True)]}
        items, withheld = A.collect_evidence([r.asDict(True) for r in self.search(plan, FACT_RESULTS).collect()])
        if not items:
            return {"provider": "extractive", "status": "abstained", "sentences": [], "reason": "no evidence"}
        if model is None:
            return A.extractive(question, items) | {"withheld": withheld}
        kept, dropped = A.verify(model(question, items), items)
        return {"provider": "model", "status": "answered" if kept else "abstained", "sentences": kept, "dropped": dropped, "withheld": withheld}
