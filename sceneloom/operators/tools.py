"""Tools and search providers as plain functions over component tables, and the models they are given."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.text import final_answer, prompt_line
from sceneloom.operators import lexical, spatial
from sceneloom.operators.components import by_id

Tool = Callable[..., DataFrame]

#: Rows of a tool's result that a policy sees (it is told whether there are more), and characters that a prompt has room for.
SHOWN, CONTEXT = 10, 2_000_000


def search_terms(components: DataFrame, query_terms: list[str], top_k: int = 10) -> DataFrame:
    return lexical.search(components, query_terms, top_k)


def search_around_component(components: DataFrame, component_id: int, radius: float, search_term: str | None = None, direction: str | None = None) -> DataFrame:
    near = spatial.around(components, component_id, radius, direction)
    if not (search_term and search_term.strip()):
        return near.select("component_id", "caption")
    return lexical.search(near, [search_term], max(1, near.count()), candidates=near)


def get_distance(components: DataFrame, component_id_1: int, component_id_2: int) -> DataFrame:
    return spatial.centre_distance(components, component_id_1, component_id_2)


def get_component_info(components: DataFrame, component_id: int) -> DataFrame:
    return by_id(components, component_id)


@dataclass
class Tools:
    """Named tools over one component table; ``allowed`` None means all."""

    components: DataFrame
    allowed: Iterable[str] | None = None
    tools: dict[str, Tool] = field(default_factory=lambda: {f.__name__: f for f in (search_terms, search_around_component, get_distance, get_component_info)})

    def names(self) -> list[str]:
        return sorted(n for n in self.tools if self.allowed is None or n in set(self.allowed))

    def parameters(self, name: str) -> dict[str, bool]:
        """The parameters of a tool and whether each must be given."""
        return {n: p.default is inspect.Parameter.empty for n, p in inspect.signature(self.tools[name]).parameters.items() if n != "components"}

    def call(self, name: str, arguments: dict | str) -> DataFrame | dict:
        """The tool's rows; what goes wrong is given as ``{"error": ...}``."""
        if name not in self.names():
            return {"error": f"no tool is called {name}"}
        try:
            return self.tools[name](self.components, **(json.loads(arguments) if isinstance(arguments, str) else arguments))
        except (TypeError, ValueError) as e:
            return {"error": str(e)}


def answered(tools: Tools, policy: Callable[[list[dict]], dict], question: str, rounds: int = 8) -> Iterator[dict]:
    """Steps of a tool-calling policy: it sees what has happened and names the next tool or gives the result.

    The policy is the caller's (a model, or a script in tests).  Ten rows of a tool's result are shown to it.
    """
    seen = [{"type": "question", "content": question}]
    for _ in range(rounds):
        step = policy(seen)
        if step.get("type") != "tool_call":
            yield step
            return
        result = tools.call(step["name"], step.get("arguments", {}))
        found = None if isinstance(result, dict) else result.limit(SHOWN + 1).collect()
        rows = result if found is None else [r.asDict(recursive=True) for r in found[:SHOWN]]
        more = {} if found is None else {"more": len(found) > SHOWN}
        seen += [step, {"type": "tool_call_result", "name": step["name"], "content": rows, **more}]
        yield seen[-1]
    yield {"type": "error", "content": f"no result after {rounds} rounds"}


def asked_in_full(components: DataFrame, replies: Callable[[str], str], question: str, characters: int = CONTEXT) -> DataFrame:
    """component_id, rank of the ids that a model's reply to the whole caption list names and that exist; the least id if there are none.

    The list is one prompt, so this suits a table that a model can read at once: one of more than ``characters`` is an error.
    """
    spark = components.sparkSession
    size = components.agg(F.sum(F.length(prompt_line(F.col("component_id"), F.col("caption"))))).first()[0] or 0
    if size > characters:
        raise ValueError(f"{size} characters of captions do not fit into {characters}")
    lines = [r["line"] for r in components.orderBy("component_id").select(prompt_line(F.col("component_id"), F.col("caption")).alias("line")).collect()]
    reply = spark.createDataFrame([(replies(question + "\n" + "".join(lines)),)], "reply string")
    named = reply.select(F.posexplode(final_answer(F.col("reply"))["component_ids"]).alias("at", "component_id")).groupBy("component_id").agg((F.min("at") + 1).alias("rank"))
    found = components.select("component_id").join(named, "component_id")
    first = components.agg(F.min("component_id").alias("component_id")).withColumn("rank", F.lit(1))
    return found if found.limit(1).count() else first


def retrieved_and_reranked(components: DataFrame, rewrite: Callable[[str], str], rerank: Callable[[str], str], question: str, k: int = 20) -> DataFrame:
    """rank, component_id, reason: the best ``k`` captions for the rewritten question by words, as far as a model's reply (JSON: component_ids, numbers with commas between, and reason) names them, in its order.

    The ``k`` captions are one prompt.  A reply that does not parse, or a model that fails, leaves the first three.
    """
    spark = components.sparkSession
    found = lexical.search(components, rewrite(question), k)
    lines = found.join(components.select("component_id", "caption"), "component_id").orderBy("rank").collect()  # k rows
    ids = [r["component_id"] for r in lines]
    prompt = "\n\n".join(f"{r['rank']}. Component {r['component_id']}: {r['caption'] or ''}" for r in lines)
    try:
        reply = json.loads(rerank(f"{question}\n{prompt}"))
        named = [int(x) for x in reply.get("component_ids", "").split(",") if x.strip()]
        chosen = [i for i in dict.fromkeys(named) if i in set(ids)]
        reason = reply.get("reason", "ranked by the model") if chosen else "the model chose none"
    except Exception as e:  # the model is the caller's, and may raise anything
        chosen, reason = ids[:3], f"best by words, the model failed: {e}"
    return spark.createDataFrame([(n, i, reason) for n, i in enumerate(chosen, 1)], "rank int, component_id int, reason string")


@dataclass
class Providers:
    """Ways of searching a catalogue's tables, by name: each takes (components, question) and gives rows with component_id."""

    tables: Callable[[str], DataFrame | None]
    ways: dict[str, Callable[[DataFrame, str], DataFrame]] = field(default_factory=lambda: {"BM25": lexical.search})

    def search(self, dataset: str | None, question: str | None, way: str = "BM25") -> tuple[int, DataFrame | dict]:
        """A status and the rows, or what is wrong: 400 for a missing name or question or an unknown way, 404 for an unknown table, 503 if the way fails."""
        if not dataset or not dataset.strip():
            return 400, {"error": "no dataset is named"}
        if not question or not question.strip():
            return 400, {"error": "no question is asked"}
        components = self.tables(dataset)
        if components is None:
            return 404, {"error": f"no dataset is called {dataset}"}
        if way not in self.ways:
            return 400, {"error": f"no way is called {way}"}
        try:
            return 200, self.ways[way](components, question)
        except Exception as e:  # ways may be the caller's
            return 503, {"error": str(e)}


def checked_parameters(fractions: dict[str, float] | None = None, percents: dict[str, float] | None = None, counts: dict[str, int] | None = None) -> None:
    """Raises ValueError, naming all that are wrong, unless fractions are in (0, 1], percents in (0, 100] and counts at least 1."""
    wrong = [f"{n} is not in (0, 1]" for n, v in (fractions or {}).items() if not 0 < v <= 1]
    wrong += [f"{n} is not in (0, 100]" for n, v in (percents or {}).items() if not 0 < v <= 100]
    wrong += [f"{n} is less than 1" for n, v in (counts or {}).items() if not v >= 1]
    if wrong:
        raise ValueError("; ".join(wrong))


def shown(output: dict) -> str | list[dict]:
    """A tool's output for a model: JSON, or where it has ``images`` a list of a text part with the rest and a part for each image."""
    images = output.get("images")
    if not images:
        return json.dumps(output)
    rest = {k: v for k, v in output.items() if k != "images"}
    return [*([{"type": "input_text", "text": json.dumps(rest)}] if rest else []), *({"type": "input_image", "image_url": url} for url in images)]


def batched(rows: DataFrame, model: Callable[[list], list], column: str, out: str, kind: str = "string") -> DataFrame:
    """``rows`` with what a model makes of a column, batch by batch in the order of the rows (captions, labels, vectors)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: model(pdf[column].tolist())})

    return rows.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, `{out}` {kind}")


def stubbed_captions(crops: DataFrame) -> DataFrame:
    """component_id, caption, crop_filename: a caption without a model, from the crop that comes first by a hash of its name."""
    chosen = crops.groupBy("component_id").agg(F.min_by("crop_filename", F.struct(F.xxhash64("crop_filename"), "crop_filename")).alias("crop_filename"))
    return chosen.withColumn("caption", F.concat(F.lit("A crop of component "), F.col("component_id").cast("string")))


def checked_pairs(reply: DataFrame) -> DataFrame:
    """question, answer, type of the question-answer lists (reply string) that parse and have all three."""
    parsed = F.from_json("reply", "ARRAY<STRUCT<Question: STRING, Answer: STRING, Type: STRING>>")
    return reply.select(F.explode(parsed).alias("q")).where("q.Question IS NOT NULL AND q.Answer IS NOT NULL AND q.Type IS NOT NULL").select(F.col("q.Question").alias("question"), F.col("q.Answer").alias("answer"), F.col("q.Type").alias("type"))


def step_recorded(stats: DataFrame, step: DataFrame) -> DataFrame:
    """Runtime statistics (dataset_name, step, duration_seconds, status) with one step put in or replaced."""
    return stats.join(step, ["dataset_name", "step"], "left_anti").unionByName(step)


def step_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("dataset_name").agg(F.sum("duration_seconds").alias("total_duration_seconds"), F.count(F.lit(1)).alias("steps"))
