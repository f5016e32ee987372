"""Calls of a model over batches of items: prompts, answers, repair rounds, usage. The model is a function that callers give."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from longleaf.functions.responses import read_items

#: Output tokens: for one of input, for a block, for a request; least and most; fixed values.
PER_TOKEN, PER_BLOCK, LEAST_OUT, MOST_OUT = 3, 128, 512, 8192
Model = Callable[[str], str]


def mock(mode: str = "identity", language: str = "it") -> Model:
    """The stand-in for a model: gives back what it is sent, with a prefix, in capitals, or no JSON at all."""

    def answer(prompt: str) -> str:
        if mode == "malformed":
            return "not JSON"
        items = json.loads(prompt[prompt.index("{") :])["items"]
        change = {"identity": str, "prefix": lambda s: f"[{language}] {s}", "upper": str.upper}[mode]
        return json.dumps({"items": [{"id": i["id"], "translation": change(i["text"])} for i in items]}, ensure_ascii=False)

    return answer


def prompt(items: list[tuple[str, str]], source: str, target: str, glossary: list[tuple[str, str]] = ()) -> str:
    """The request for items (id, text): what to do, the terms that stand in them, and the items as JSON."""
    terms = [f"{a} => {b}" for a, b in dict.fromkeys(glossary) if any(a.lower() in t.lower() for _, t in items)]
    head = f"Translate from {source} to {target}. Keep markers and numbers. Answer with JSON: items, each with id and translation."
    return "\n".join([head, *(["Terms:", *terms] if terms else []), json.dumps({"items": [{"id": i, "text": t} for i, t in items]}, ensure_ascii=False)])


def output_budget(tokens: int, blocks: int, prompt_tokens: int = 0, window: int | None = None) -> int:
    """Output tokens that a request may have, within what its prompt leaves of the model's window."""
    own = min(max(tokens * PER_TOKEN + PER_BLOCK * blocks, LEAST_OUT), MOST_OUT)
    return own if window is None else max(min(own, window - prompt_tokens), 1)


def apportioned(total: int, weights: list[int]) -> list[int]:
    """A total dealt by weight in whole numbers; the last takes what is left."""
    whole = sum(weights)
    shares = [total * w // whole if whole else 0 for w in weights]
    return [*shares[:-1], total - sum(shares[:-1])] if shares else []


def rounds(items: list[tuple[str, str]], model: Model, source: str, target: str, most: int = 3, glossary: list[tuple[str, str]] = ()) -> tuple[dict[str, str], dict[str, str], int, int, int]:
    """(translations, errors, requests, tokens in, tokens out) of one batch.

    A refused answer is asked for again in halves, items that failed alone in the next round; after the last round what
    is left is an error.
    """
    done: dict[str, str] = {}
    errors: dict[str, str] = {}
    requests = sent = got = 0
    pending = [items] if items else []
    for _ in range(most):
        again: list[list[tuple[str, str]]] = []
        for batch in pending:
            text = prompt(batch, source, target, glossary)
            answer = model(text)
            requests, sent, got = requests + 1, sent + -(-len(text) // 4), got + -(-len(answer) // 4)
            found, failed, error = read_items(answer, dict(batch))
            done.update(found)
            if error:
                errors.update({i: error for i, _ in batch})
                half = len(batch) // 2
                again += [b for b in (batch[:half], batch[half:]) if b]
            else:
                errors.update(failed)
                again += [[x] for x in batch if x[0] not in done]
        pending = again
        if not pending:
            break
    return done, {i: errors.get(i, "no answer") for i, _ in items if i not in done}, requests, sent, got


def translate(batches: DataFrame, model: Model, source: str = "en", target: str = "it", most: int = 3, glossary: list[tuple[str, str]] = ()) -> DataFrame:
    """(batch, item, translation, error, tokens_in, tokens_out) of items (batch, item, text), whose batches are of bounded size.

    The rows of a batch are dealt to one task and sent together. A task that runs again asks again, so a model must take the same
    request twice; usage of a batch is dealt to its items by their length.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def answered() -> pd.DataFrame:
            items = [(i, t or "") for _, i, t in held]
            done, errors, _, sent, got = rounds(items, model, source, target, most, glossary)
            weights = [len(t) + 1 for _, t in items]
            ins, outs = apportioned(sent, weights), apportioned(got, weights)
            return pd.DataFrame({"batch": [b for b, *_ in held], "item": [i for i, _ in items], "translation": [done.get(i) for i, _ in items], "error": [errors.get(i) for i, _ in items], "tokens_in": ins, "tokens_out": outs})

        for f in frames:
            for row in zip(f["batch"], f["item"], f["text"], strict=True):
                if held and held[0][0] != row[0]:
                    yield answered()
                    held.clear()
                held.append(row)
        if held:
            yield answered()

    rows = batches.select(batches["batch"].cast("string").alias("batch"), batches["item"].cast("string").alias("item"), "text")
    return rows.repartition("batch").sortWithinPartitions("batch", "item").mapInPandas(each, "batch string, item string, translation string, error string, tokens_in long, tokens_out long")
