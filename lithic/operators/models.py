"""Model calls behind one interface, with validation, retries, escalation and a deterministic offline
provider, so that every pipeline runs without a network."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from lithic.functions import text as T
from lithic.settings import CATEGORIES, DEFAULTS

DIMENSIONS = 64
NO_ANSWER = "No answer can be given from the indexed pages."
NO_REPORT = "No report can be given from the collected material."


class ProviderError(Exception):
    """A failed call; ``window`` names the exhausted quota, if that is why: minute, day or balance."""

    def __init__(self, message: str, retryable: bool = False, window: str | None = None) -> None:
        super().__init__(message)
        self.retryable, self.window = retryable, window


class Exhausted(Exception):
    """No provider gave a result; ``quota_only`` if quotas are the only reason."""

    def __init__(self, causes: list[ProviderError]) -> None:
        super().__init__("no provider gave a result")
        self.causes, self.quota_only = causes, all(c.window for c in causes)


class Unavailable(RuntimeError):
    """What was asked for is not configured."""


def failure(status: int, body: str = "") -> ProviderError | None:
    """What an HTTP status of a provider means: 429 an exhausted minute, or day if the body says so; 402 a spent
    balance; 408 and the server's own errors may be tried again; other errors may not. None below 400."""
    if status == 429:
        return ProviderError("HTTP 429", window="day" if re.search(r"per[ _-]?day|daily", body, re.I) else "minute")
    if status == 402:
        return ProviderError("HTTP 402", window="balance")
    return ProviderError(f"HTTP {status}", retryable=status == 408 or status >= 500) if status >= 400 else None


#: Two shapes of completion requests: their path, their body, and where their answers have the text.
def chat_request(model: str, prompt: str, text: str) -> tuple[str, dict]:
    return "/chat/completions", {"model": model, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": text}]}


def content_request(model: str, prompt: str, text: str) -> tuple[str, dict]:
    return f"/models/{model}:generateContent", {"systemInstruction": {"parts": [{"text": prompt}]}, "contents": [{"role": "user", "parts": [{"text": text}]}]}


def answer_text(body: dict) -> str:
    """The text of an answer of either shape."""
    try:
        if "choices" in body:
            return body["choices"][0]["message"]["content"]
        return "".join(part["text"] for part in body["candidates"][0]["content"]["parts"])
    except (KeyError, IndexError, TypeError) as wrong:
        raise ProviderError("an answer without a text") from wrong


def http_provider(post: Callable[[str, dict], tuple[int, str]], model: str, shape: Callable[[str, str, str], tuple[str, dict]] = chat_request) -> Callable[[str, str], str]:
    """A provider over a function that posts a path and a body and gives status and answer."""

    def complete(task: str, text: str) -> str:
        try:
            status, answer = post(*shape(model, PROMPTS[task], text))
        except ProviderError:
            raise
        except Exception as wrong:  # noqa: BLE001  a client may raise anything
            raise ProviderError("the request failed", retryable=True) from wrong
        if wrong := failure(status, answer):
            raise wrong
        try:
            return answer_text(json.loads(answer))
        except ValueError as wrong:
            raise ProviderError("an answer that is no JSON") from wrong

    return complete


PROMPTS = {task: f"{what} Answer with a JSON object that has a confidence between 0 and 1." for task, what in {"summarize": "Summarize the page.", "classify": "Choose the page's category.", "translate": "Translate the page to English.", "detect": "Name the page's language by its code.", "entities": "List the page's named entities.", "rewrite": "Write the question as a search query.", "answer": "Answer from the sources and cite them.", "report": "Report on the sources and cite them."}.items()}

#: Fixed values of the deterministic embedder: words by concept, each concept an axis, and the weights.
CONCEPTS = {
    "cripto": "bitcoin blockchain criptomoeda criptomoedas monero moeda moedas".split(),
    "documentos": "passaporte passaportes documentos identidade falsificados".split(),
    "vazamento": "vazamento vazamentos senhas credenciais dump".split(),
}
CONCEPT_WEIGHT, WORD_WEIGHT = 3.0, 0.3
AXIS = {word: axis for axis, words in enumerate(CONCEPTS.values()) for word in words}


@functools.lru_cache(1 << 16)
def axis_of(word: str) -> int:
    """A concept's axis for its words; for any other one of the rest, by the 31-polynomial of its characters."""
    if word in AXIS:
        return AXIS[word]
    code = 0
    for at in range(0, len(raw := word.encode("utf-16-be", "surrogatepass")), 2):
        code = (code * 31 + int.from_bytes(raw[at : at + 2], "big")) & 0xFFFFFFFF
    signed = code - (1 << 32) if code >> 31 else code
    return len(CONCEPTS) + signed % (DIMENSIONS - len(CONCEPTS))


def embed(text: str) -> list[float]:
    """A unit vector by the words' axes: the offline stand-in of an embedding model. A text without words lies on
    the last axis."""
    out = [0.0] * DIMENSIONS
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        axis = axis_of(word)
        out[axis] += CONCEPT_WEIGHT if axis < len(CONCEPTS) else WORD_WEIGHT
    norm = math.sqrt(sum(x * x for x in out))
    if not norm:
        out[-1] = norm = 1.0
    return [x / norm for x in out]


#: Fixed wording of what an embedder is given.
def as_query(text: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), text)


def as_document(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("none")), F.lit(" | text: "), text)


def embed_in_batches(texts: list[str], call: Callable[[list[str]], list[list[float]]], width: int = DIMENSIONS, size: int = DEFAULTS.embed_batch) -> list[list[float]]:
    """Vectors of texts in their order, asked for in batches; a batch that answers with another number of vectors,
    or vectors of another width, is an error."""
    out: list[list[float]] = []
    for at in range(0, len(texts), size):
        batch = texts[at : at + size]
        found = call(batch)
        if len(found) != len(batch) or any(len(v) != width for v in found):
            raise ProviderError("an embedding batch of another shape")
        out += found
    return out


@F.arrow_udf(ArrayType(DoubleType()))
def embedding(text: pa.Array) -> pa.Array:
    done = []
    for at in range(0, len(text), DEFAULTS.embed_batch):
        done.append(pa.array(embed_in_batches(text.slice(at, DEFAULTS.embed_batch).to_pylist(), lambda batch: [embed(t) for t in batch]), pa.list_(pa.float64())))
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.float64()))


def offline(task: str, text: str) -> str:
    """JSON as a model would answer: the first sentence as a summary, a category by its name in the text (behind the
    taxonomy), capitalised words in pairs as persons."""
    if task == "summarize":
        return json.dumps({"text": re.split(r"(?<=[.!?])\s", text.strip(), maxsplit=1)[0][:200], "confidence": 0.9})
    if task == "classify":
        found = next((c for c in CATEGORIES if c in text.removeprefix(TAXONOMY).lower()), "other")
        return json.dumps({"category": found, "confidence": 0.8 if found != "other" else 0.4})
    if task == "translate":
        return json.dumps({"text": text, "confidence": 0.5})
    if task == "detect":
        return json.dumps({"code": "en" if re.search(r"\bthe\b", text.lower()) else "und", "confidence": 0.6})
    if task == "entities":
        pairs = dict.fromkeys(re.findall(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", text))
        return json.dumps({"entities": [{"type": "person", "value": p, "confidence": 0.8} for p in pairs], "confidence": 0.8})
    if task == "rewrite":
        return json.dumps({"query": " ".join(re.findall(r"[^\W_]+", text.lower())), "confidence": 0.9})
    if task in ("answer", "report"):
        first = re.search(r'<source id="([^"]*)"[^>]*>(.*?)</source>', text, re.S)
        return json.dumps({"text": first[2].strip()[:200] if first else "", "citations": [first[1]] if first else [], "confidence": 0.7})
    raise ProviderError(f"unknown task {task}")


TAXONOMY = "Categories: " + ", ".join(CATEGORIES) + "\n\n"


def outermost_object(answer: str | None) -> dict | None:
    """The JSON object in a model's answer, whatever stands around it; None if there is none."""
    found = re.search(r"\{.*\}", answer or "", re.S)
    try:
        value = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def validated(answer: str | None, field: str) -> tuple[str | None, float]:
    """(value, confidence in 0..1); a malformed answer has confidence 0."""
    value = outermost_object(answer)
    if value is None or not isinstance(value.get(field), str):
        return None, 0.0
    try:
        confidence = float(value.get("confidence", 0.0))
    except (TypeError, ValueError):
        confidence = 0.0
    return value[field], max(0.0, min(1.0, confidence))


def category(name: Column, confidence: Column) -> tuple[Column, Column]:
    """A category outside the taxonomy becomes other, at a confidence of at most one half."""
    known = name.isin(*CATEGORIES)
    return F.when(known, name).otherwise("other"), F.when(known, confidence).otherwise(F.least(confidence, F.lit(0.5)))


def json_object(answer: Column) -> Column:
    return F.regexp_extract(answer, r"(?s)\{.*\}", 0)


class Registry:
    """Providers by name, asked in order: retries, validation, escalation below the confidence floor,
    and a cache of answers by task, prompt and input, which expire. Without providers every call is refused."""

    @classmethod
    def of(cls, configured: dict[str, dict], post: Callable[[str, dict], tuple[int, str]], **more) -> Registry:
        """Providers by id from configuration: a model, and whether the request has the second shape."""
        return cls({name: http_provider(post, c["model"], content_request if c.get("shape") == "content" else chat_request) for name, c in configured.items()}, **more)

    def __init__(self, providers: dict[str, Callable[[str, str], str]], floor: float = DEFAULTS.min_entity_confidence, escalations: int = DEFAULTS.max_escalations, pause: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> None:
        self.providers, self.floor, self.escalations, self.pause, self.clock = providers, floor, escalations, pause, clock
        self.cache: dict[tuple[str, str], tuple[float, tuple[str, float]]] = {}

    def _ask(self, name: str, task: str, text: str) -> str:
        for attempt in range(3):
            try:
                return self.providers[name](task, text)
            except ProviderError as wrong:
                if attempt == 2 or not wrong.retryable or wrong.window:
                    raise
                self.pause(0.2 * (attempt + 1))
        raise AssertionError

    def call(self, task: str, text: str, field: str) -> tuple[str, float]:
        if not self.providers:
            raise Unavailable("no provider is configured")
        key = task, hashlib.sha256(f"{PROMPTS.get(task, '')}\n{text}".encode()).hexdigest()
        at, kept = self.cache.get(key, (-math.inf, None))
        if kept is not None and self.clock() - at < DEFAULTS.cache_hours * 3600:
            return kept
        best, causes = None, []
        for name in list(self.providers)[: self.escalations + 1]:
            try:
                value, confidence = validated(self._ask(name, task, text), field)
            except ProviderError as wrong:
                causes.append(wrong)
                continue
            if value is not None and (best is None or confidence > best[1]):
                best = value, confidence
            if best and best[1] >= self.floor:
                self.cache[key] = self.clock(), best
                break
        if best is None:
            raise Exhausted(causes)
        return best


def task_udf(task: str, field: str, provider: Callable[[str, str], str] = offline):
    """A UDF: text to struct(value, confidence, error), over texts cut to the model's limit before; the error
    is quota or failed, and what came before it in the batch is kept. A null text asks for nothing and costs no
    call; a model may answer anew each time, so Spark does not repeat a call where its answer is used twice."""

    def one(text: str | None) -> tuple:
        if text is None:
            return None, 0.0, None
        try:
            value, confidence = validated(provider(task, text), field)
            return value, confidence, None if value is not None else "failed"
        except ProviderError as wrong:
            return None, 0.0, "quota" if wrong.window else "failed"

    kind = pa.struct({"value": pa.string(), "confidence": pa.float64(), "error": pa.string()})

    @F.arrow_udf(StructType([StructField("value", StringType()), StructField("confidence", DoubleType()), StructField("error", StringType())]))
    def run(text: pa.Array) -> pa.Array:
        return T.by_slices(lambda t: dict(zip(("value", "confidence", "error"), one(t), strict=True)), [text], kind)

    run = run.asNondeterministic()
    return lambda text: run(F.left(text, F.lit(DEFAULTS.model_chars)))


NAMED = ArrayType(StructType([StructField("type", StringType()), StructField("value", StringType()), StructField("confidence", DoubleType())]))


def entities_udf(provider: Callable[[str, str], str] = offline):
    """A UDF: text, cut to the model's limit, to struct(entities, error); a null text costs no call."""

    def one(text: str | None) -> tuple:
        if text is None:
            return None, None
        try:
            found = outermost_object(provider("entities", text))
            listed = (found or {}).get("entities")
            if not isinstance(listed, list):
                return None, "failed"
            return [(str(e.get("type")), str(e.get("value")), float(e.get("confidence") or 0.0)) for e in listed if isinstance(e, dict)], None
        except ProviderError as wrong:
            return None, "quota" if wrong.window else "failed"

    named = pa.list_(pa.struct({"type": pa.string(), "value": pa.string(), "confidence": pa.float64()}))
    kind = pa.struct({"entities": named, "error": pa.string()})

    def row(text: str | None) -> dict:
        found, error = one(text)
        return {"entities": None if found is None else [dict(zip(("type", "value", "confidence"), e, strict=True)) for e in found], "error": error}

    @F.arrow_udf(StructType([StructField("entities", NAMED), StructField("error", StringType())]))
    def run(text: pa.Array) -> pa.Array:
        return T.by_slices(row, [text], kind)

    run = run.asNondeterministic()
    return lambda text: run(F.left(text, F.lit(DEFAULTS.model_chars)))


def cited(wanted: Column, sent: Column) -> Column:
    """The cited ids that were sent, in order, once each."""
    return F.array_distinct(F.filter(wanted, lambda c: F.array_contains(sent, c)))
