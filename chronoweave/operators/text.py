"""Keyword trends, term counts, topics, and records from web pages."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = ("freedom", "economy", "war", "rights", "government")


def cleaned(c: str | Column) -> Column:
    """Lower case, runs of other characters than letters, digits and _ as one space (in any script)."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "))


def occurrences(c: Column, word: str) -> Column:
    """How often a string occurs without overlaps, inside longer words too."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def keyword_trend(docs: DataFrame, by: list[str], words: tuple[str, ...] = KEYWORDS, text: str = "text") -> DataFrame:
    c = docs.withColumn("c_", cleaned(text))
    return c.groupBy(*by).agg(*(F.sum(occurrences(F.col("c_"), w)).alias(w) for w in words))


def term_counts(docs: DataFrame, stop: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """(term, n) of words of two letters or more; counted in tasks before the shuffle."""
    words = docs.select(F.explode(F.split(cleaned(text), " ")).alias("term")).where(F.length("term") > 1)
    return (words.where(~F.col("term").isin(*stop)) if stop else words).groupBy("term").agg(F.count("*").alias("n"))


def topics(docs: DataFrame, k: int = 5, vocabulary: int = 1000, words: int = 10, text: str = "text", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """LDA: (topic, rank, term, weight) of the strongest words, and docs with their dominant topic."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, StopWordsRemover
    from pyspark.ml.functions import vector_to_array

    steps = [CountVectorizer(inputCol="k_", outputCol="f_", vocabSize=vocabulary), LDA(k=k, seed=seed, maxIter=10, featuresCol="f_")]
    stop = StopWordsRemover().getStopWords()
    # words by built-ins: each transformer that hands on words would copy all of them out of Spark's rows and back
    d = docs.withColumn("k_", F.filter(F.split(cleaned(text), " "), lambda w: (w != "") & ~w.isin(stop)))
    model = Pipeline(stages=steps).fit(d)
    vocab = F.array(*map(F.lit, model.stages[0].vocabulary))
    top = model.stages[1].describeTopics(words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    top = top.select("topic", "rank", F.get(vocab, F.col("t.termIndices")).alias("term"), F.col("t.termWeights").alias("weight"))
    share = vector_to_array("topicDistribution")
    dominant = F.array_position(share, F.array_max(share)) - 1
    return top, model.transform(d).withColumn("topic", dominant).select(*docs.columns, "topic")


def classify(features: DataFrame, cols: list[str], label: str, test, trees: int = 20, seed: int = 42) -> DataFrame:
    """(label, n, accuracy) of the rows for which test holds, by a forest fitted on all others; missing features count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    steps = [StringIndexer(inputCol=label, outputCol="l_", handleInvalid="keep"), VectorAssembler(inputCols=cols, outputCol="f_"), RandomForestClassifier(labelCol="l_", featuresCol="f_", numTrees=trees, seed=seed)]
    d = features.na.fill(0.0, cols)
    scored = Pipeline(stages=steps).fit(d.where(~test)).transform(d.where(test))
    return scored.groupBy(label).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("l_")).cast("double")).alias("accuracy"))


def first_links(pages: DataFrame, n: int, html: str = "html") -> DataFrame:
    """(page_id, place, link) of the first n href values in their order, from 0."""
    found = F.posexplode(F.slice(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1), 1, n)).alias("place", "link")
    return pages.select("page_id", found).withColumn("place", F.col("place").cast("long"))


def links(pages: DataFrame, html: str = "html", containing: str = "") -> DataFrame:
    """(page_id, link) of all href values that contain a string."""
    found = F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1))
    return pages.select("page_id", found.alias("link")).where(F.contains("link", F.lit(containing)))


# Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PART = re.compile(r"\s*(?P<child>>)?\s*(?P<tag>\*|[\w-]+)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+(?:[*^$]?=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)")
_TERM = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([*^$]?=)(?:\"([^\"]*)\"|'([^']*)'|([^\]]*)))?\]")


def compiled(selector: str) -> list[tuple[bool, Callable[[str, dict], bool]]]:
    """The steps of a selector: whether each must be a child of the one before, and its test of a tag and its attributes.

    Understood are tags, ``*``, .class, #id, [name], [name=value] (also ``*=``, ``^=``, ``$=``), descendants and ``>``.
    """
    steps, at = [], 0
    while at < len(selector.rstrip()):
        m = _PART.match(selector, at)
        if m.end() == at or not (m["tag"] or m["rest"]):
            raise ValueError(f"not a selector: {selector!r}")
        terms = [(k, n, a, op or "", next((v for v in (x, y, z) if v is not None and v != ""), "")) for k, n, a, op, x, y, z in _TERM.findall(m["rest"])]

        def test(tag: str, attrs: dict, want=m["tag"], terms=terms) -> bool:
            if want not in (None, "*", tag):
                return False
            for kind, name, attr, op, value in terms:
                if kind:
                    have = attrs.get("class" if kind == "." else "id") or ""
                    if name not in have.split() if kind == "." else name != have:
                        return False
                    continue
                have = attrs.get(attr)
                fits = {"": lambda: True, "=": lambda: have == value, "*=": lambda: value in have, "^=": lambda: have.startswith(value), "$=": lambda: have.endswith(value)}
                if attr not in attrs or op and (have is None or not fits[op]()):
                    return False
            return True

        steps.append((bool(m["child"]), test))
        at = m.end()
    return steps


class _Matches(HTMLParser):
    """The attribute of every element that a selector's steps lead to, in the page's order; ends that are missing close with the element around them."""

    def __init__(self, steps: list, attribute: str):
        super().__init__()
        self.steps, self.attribute, self.found = steps, attribute, []
        self.path: list[tuple[str, frozenset]] = []  # open elements: tag, and the numbers of steps that end in it

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        within = frozenset().union(*(met for _, met in self.path))
        above = self.path[-1][1] if self.path else frozenset()
        met = frozenset(i for i, (child, test) in enumerate(self.steps) if (i == 0 and not (child and self.path) or i and i - 1 in (above if child else within)) and test(tag, attrs))
        if len(self.steps) - 1 in met and attrs.get(self.attribute) is not None:
            self.found.append(attrs[self.attribute])
        if tag not in VOID:
            self.path.append((tag, met))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.path.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                break


def selected(pages: DataFrame, selector: str, attribute: str = "href", html: str = "html") -> DataFrame:
    """(page_id, place, value): an attribute of every element that a selector matches, in the page's order from 0.

    Pages are parsed, so that quoting, entities and comments are what a browser takes them for; a null page has no elements.
    """
    compiled(selector)  # an error at once, not in a task

    def run(batches):
        steps = compiled(selector)
        for b in batches:
            owner, place, value = [], [], []
            for page, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = _Matches(steps, attribute)
                m.feed(text or "")
                m.close()
                owner += [page] * len(m.found)
                place += range(len(m.found))
                value += m.found
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(place, pa.int64()), pa.array(value, pa.string())], names=["page_id", "place", "value"])

    return pages.select("page_id", html).mapInArrow(run, "page_id long, place long, value string")


class _Record(HTMLParser):
    """Title, paragraphs and dt / dd pairs of a page."""

    def __init__(self):
        super().__init__()
        self.tag, self.title, self.text, self.pairs, self.key = "", "", [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag in ("title", "p", "dt", "dd"):
            self.tag, self.data = tag, ""

    def handle_data(self, data):
        if self.tag:
            self.data += data

    def handle_endtag(self, tag):
        if tag != self.tag:
            return
        value = " ".join(self.data.split())
        if tag == "title":
            self.title = value
        elif tag == "p":
            self.text.append(value)
        elif tag == "dt":
            self.key = value
        else:
            self.pairs.append((self.key, value))
        self.tag = ""


def records(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, title, text, fields): fields is a map of the page's dt / dd pairs, whatever keys it has."""

    def run(batches):
        for b in batches:
            out = []
            for page in b.column(1).to_pylist():
                r = _Record()
                r.feed(page or "")
                out.append((r.title, "\n".join(r.text), list(dict(r.pairs).items())))
            kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
            cols = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["page_id", "title", "text", "fields"])

    return pages.select("page_id", html).mapInArrow(run, "page_id long, title string, text string, fields map<string,string>")
