"""Optional model providers: prompts, calls with retries, strict checks of answers, candidates.

A provider is any function (system, user) -> text.  Calls run in mapInPandas on the executors, so
credentials and clients are made there; nothing is called unless a provider is given.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as K
from ..sources.files import secret, shared_folder
from .extract import COLUMNS, DISCHARGE, SCHEMA
from .segment import regions, sentence_of, sentences, split_sections

WORTH = {"local": 0.82, "api": 0.85}
ABSENT = {"0", "N", K.MISSING}


@dataclass(frozen=True)
class Batch:
    """Fields that are asked for together, and the text they are asked of."""

    fields: tuple[str, ...]
    text: str
    whole: bool


def batches_of(text: str, fields, most: int = 14_000) -> list[Batch]:
    """By group: fields of sections share those sections' text; fields of the whole text are asked apart."""
    found, out = split_sections(text), []
    for group in K.GROUPS:
        for whole in (False, True):
            some = tuple(f for f in fields if K.GROUP_OF[f] == group and ("episode" in K.SOURCES_OF[f]) == whole)
            if not some:
                continue
            if whole:
                body = text
            else:
                spans = list(dict.fromkeys(s for f in some for s in regions(text, found, K.SOURCES_OF[f])))
                body = "\n".join(text[a:b] for a, b in sorted(spans))
                if K.SOURCES_OF[some[0]] == ("meds",) and "meds" not in found:
                    m = re.search("(?i)" + DISCHARGE, text)
                    body = text[m.start():] if m else text[-most:]
            out.append(Batch(some, body[:most], whole))
    return out


def prompt(batch: Batch, feedback: str = "") -> tuple[str, str]:
    """(system, user): a card a field, the form of the answer, what was wrong last time, the text."""
    cards = [{"field": f, "kind": K.KIND_OF[f], "closed_values": K.CLOSED.get(f, "").split(), "missing": K.MISSING} for f in batch.fields]
    form = {f: {"value": "", "evidence": ""} for f in batch.fields}
    system = "Extract the fields from the document between the markers. Answer with one JSON object of exactly the given form; every evidence is an exact quote."
    user = "\n".join(["FIELDS " + json.dumps(cards, ensure_ascii=False), "FORM " + json.dumps(form, ensure_ascii=False), *(["CORRECT " + feedback] if feedback else []), "<document>", batch.text, "</document>"])
    return system, user


def json_object(answer: str) -> dict:
    """From the first { to the last }; anything but an object is an error."""
    body = answer[answer.find("{"): answer.rfind("}") + 1]
    try:
        out = json.loads(body)
    except ValueError as e:
        raise ValueError(f"not JSON: {e}") from None
    if not isinstance(out, dict):
        raise ValueError("not an object")
    return out


def well_formed(field: str, value: str) -> bool:
    """Whether a text has the form of its field's kind: the same tests as of columns, for one answer."""
    kind = K.KIND_OF[field]
    if field == "diagnosis_icd":
        return bool(re.fullmatch(r"[A-ZА-Яa-zа-я]\d{2}(?:\.\d{1,3})?", value))
    if kind == "date":
        try:
            return bool(re.fullmatch(r"\d{2}\.\d{2}\.\d{4}", value)) and datetime.strptime(value, "%d.%m.%Y") is not None
        except ValueError:
            return False
    if kind == "bp":
        m = re.fullmatch(r"(\d{2,3})/(\d{2,3})", value)
        return bool(m) and 50 <= int(m[1]) <= 300 and 20 <= int(m[2]) <= 200 and int(m[1]) >= int(m[2])
    if kind == "number":
        low, high = K.RANGES.get(field, (float("-inf"), float("inf")))
        return bool(re.fullmatch(r"-?\d+(?:\.\d+)?", value)) and low <= float(value) <= high
    return True


def check_payload(payload: dict, text: str, fields) -> None:
    """Exactly the fields asked for, texts for values, exact quotes for evidence."""
    if set(payload) != set(fields):
        raise ValueError(f"fields differ: {sorted(set(payload) ^ set(fields))}")
    for f, item in payload.items():
        if not isinstance(item, dict) or not isinstance(item.get("value"), str) or not isinstance(item.get("evidence"), str):
            raise ValueError(f"{f}: value and evidence must be texts")
        value, quote = item["value"].strip(), item["evidence"]
        closed = K.CLOSED.get(f, "").split() or (["0", "1"] if K.KIND_OF[f] == "binary" else [])
        if closed and value not in (*closed, K.MISSING):
            raise ValueError(f"{f}: {value!r} is not allowed")
        if value != K.MISSING and not well_formed(f, value):
            raise ValueError(f"{f}: {value!r} has not the form of a {K.KIND_OF[f]}")
        if quote and quote not in text:
            raise ValueError(f"{f}: the evidence is not a quote")
        if not quote and value not in ABSENT:
            raise ValueError(f"{f}: a value needs evidence")


def payload_rows(payload: dict, text: str, source: str) -> list[dict]:
    """Candidates; a quote is placed at its first occurrence in the whole text."""
    spans, out = sentences(text), []
    for k, (f, item) in enumerate(payload.items()):
        value, quote = item["value"].strip(), item["evidence"]
        if value == K.MISSING:
            continue
        at = text.find(quote) if quote else -1
        coded = at < 0 and value in ABSENT
        worth = WORTH.get(source, 0.8)
        row = {"field": f, "ord": k, "value": value, "source": source, "confidence": worth if at >= 0 or coded else max(0.20, worth - 0.35), "raw_value": value, "absence": coded, "denied": False, "start": at, "end": at + len(quote) if at >= 0 else -1, "evidence": quote if at >= 0 else "", "sentence": "", "placed": at >= 0}
        if at >= 0:
            a, b = sentence_of(spans, at, at + len(quote))
            row["sentence"] = text[a:b]
        out.append(row)
    return out


def ask(provider: Callable[[str, str], str], batch: Batch, retries: int = 2, pause: float = 0.5) -> dict:
    """An answer that passes the checks; the last error is told to the provider, then raised."""
    feedback = ""
    for k in range(retries + 1):
        try:
            payload = json_object(provider(*prompt(batch, feedback)))
            check_payload(payload, batch.text, batch.fields)
            return payload
        except Exception as e:  # providers fail in ways of their own
            if k == retries:
                raise
            feedback = str(e)
            time.sleep(pause * 2**k)
    raise AssertionError


def chat_provider(url: str, model: str, key_variable: str, timeout: float = 90, most_tokens: int = 1200) -> Callable[[str, str], str]:
    """A chat endpoint; the key is read from the executor's environment."""

    def call(system: str, user: str) -> str:
        body = {"model": model, "temperature": 0, "max_tokens": most_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(key_variable, '')}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    return call


#: Variables that switch a provider off, texts that do so, and a key that is none.
SWITCHES = {"api": "LLM_API_ENABLED", "local": "LOCAL_LLM_ENABLED"}
OFF = ("0", "false", "no", "off")
NO_KEY = "PUT_API_KEY_HERE"


def usable(config: dict, env=None) -> dict[str, bool]:
    """Which providers a configuration and the environment allow: a variable can switch each off, but
    not on; the API needs an address, a model and a key as well."""
    env = os.environ if env is None else env
    steps, api, models = (config.get(k) or {} for k in ("pipeline", "api", "models"))
    key = secret(api, env)
    asked = {
        "api": steps.get("use_api") and api.get("enabled") and api.get("mode", "uncertain") != "disabled" and all((api.get("base_url"), api.get("model"), key, key != NO_KEY)),
        "local": steps.get("use_local") and models.get("local_enabled", True) and "disabled" not in (models.get("local_backend", "disabled"), steps.get("local_mode", "uncertain")),
    }
    return {k: bool(v) and env.get(SWITCHES[k], "").strip().lower() not in OFF for k, v in asked.items()}


def configured(config: dict, make: Callable[[str, dict], Callable[[str, str], str]], env=None) -> tuple[dict[str, Callable], list[tuple[str, str]]]:
    """The providers that are usable, each made once by make(name, its settings), and (name, error) of
    those that could not be made; a run goes on without them."""
    made, failed = {}, []
    for name in (n for n, ok in usable(config, env).items() if ok):
        try:
            made[name] = make(name, config["api" if name == "api" else "models"])
        except Exception as e:  # providers fail in ways of their own
            failed.append((name, repr(e)))
    return made, failed


def provider_candidates(docs: DataFrame, asked: DataFrame, provider: Callable[[str, str], str], source: str = "api", retries: int = 2, pause: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Candidates, and errors (doc_id, error).  docs (doc_id, text); asked (doc_id, field): documents
    that nothing is asked of never reach the provider.  A document whose call fails for good has no
    candidates of this provider.  Answers are kept in the shared folder: a provider is asked once,
    whatever is made of its candidates and errors."""
    shared_folder(docs.sparkSession)
    want = asked.groupBy("doc_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    rows = docs.select("doc_id", "text").join(want, "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text, fields in zip(pdf["doc_id"], pdf["text"], pdf["fields"], strict=True):
                try:
                    found = [r for b in batches_of(text or "", list(fields)) for r in payload_rows(ask(provider, b, retries, pause), text or "", source)]
                    out += [{"doc_id": i, "error": None} | r for r in found]
                except Exception as e:
                    out.append({"doc_id": i, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame(out, columns=[*COLUMNS, "error"]).astype(object).where(lambda x: x.notna(), None)

    both = rows.mapInPandas(run, SCHEMA.format(id=kind) + ", error string").checkpoint()
    return both.where("error IS NULL").drop("error"), both.where("error IS NOT NULL").select("doc_id", "error")
