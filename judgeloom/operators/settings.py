"""Settings of a run: what they may be, and where they come from."""

from __future__ import annotations

import hashlib
import json
import math
import os
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import Rules
from .refine import Weights


def normalise_use(value: str) -> str:
    """The only chunking there is, however it is written."""
    if value.strip().lower() != "semantic":
        raise ValueError(f"Unknown use: {value}")
    return "semantic"


def use(value: Column) -> Column:
    """The same of a column; what isn't known is null."""
    return F.when(F.lower(T.strip(value)) == "semantic", "semantic")


@dataclass(frozen=True)
class Evaluation:
    # The published defaults.
    max_samples: int | None = None
    max_total_length: int = 6144
    max_latent_tokens: int = 256
    max_answer_tokens: int = 8
    topk_interpolation: int = 10
    gumbel_temperature: float = 1.0
    noise_scale: float = 1.0
    vote: int = 1
    active_rollouts: int = 80

    def faults(self) -> list[str]:
        """The settings that can't be, by name."""
        out = [f.name for f in fields(self) if f.name != "noise_scale" and getattr(self, f.name) is not None and getattr(self, f.name) <= 0]
        if self.noise_scale < 0:
            out.append("noise_scale")
        if self.max_latent_tokens + self.max_answer_tokens >= self.max_total_length:
            out.append("max_total_length")
        return sorted(set(out))


def row_faults(**given: Column) -> Column:
    """The same of settings in columns: names in order.  What isn't given has its
    default; a null is no fault."""
    value = {f.name: given.get(f.name, F.lit(f.default)) for f in fields(Evaluation)}
    wrong = {name: c < 0 if name == "noise_scale" else c <= 0 for name, c in value.items()}
    no = lambda c: F.coalesce(c, F.lit(False))
    wrong["max_total_length"] = no(wrong["max_total_length"]) | no(value["max_latent_tokens"] + value["max_answer_tokens"] >= value["max_total_length"])
    return F.array_compact(F.array(*[F.when(wrong[name], name) for name in sorted(wrong)]))


def row_entries(**given: Column) -> dict[str, Column]:
    """Settings by name as JSON values, for a digest of each row's; a null is
    ``null``, what isn't given has its default."""
    as_json = lambda c: F.coalesce(F.get_json_object(F.to_json(F.struct(c.alias("v"))), "$.v"), F.lit("null"))
    return {f.name: as_json(given[f.name]) if f.name in given else F.lit(json.dumps(f.default)) for f in fields(Evaluation)}


def signature(settings: dict) -> str:
    """A digest of settings, by their names in order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def chunk_policy(text: str | None = None, variable: str = "CHUNK_POLICY") -> tuple[Rules, Weights]:
    """Rules and weights of chunking, changed by a JSON object: given, or in an
    environment variable.  An unknown name is an error; the wider window is one
    more than the usual one unless it is given."""
    changes = json.loads(text if text is not None else os.environ.get(variable, "{}"))
    rules = {f.name for f in fields(Rules)}
    weights = {f.name for f in fields(Weights)}
    if unknown := set(changes) - rules - weights:
        raise ValueError(f"Unknown settings: {sorted(unknown)}")
    if "displacement" in changes and "rescue" not in changes:
        changes["rescue"] = changes["displacement"] + 1
    return replace(Rules(), **{k: v for k, v in changes.items() if k in rules}), replace(Weights(), **{k: v for k, v in changes.items() if k in weights})


def training_steps(records: int, workers: int, batch: int, accumulation: int, epochs: int, warmup: int, decay: int) -> int:
    """Steps of an epoch, each part rounded up."""
    if epochs < 1:
        raise ValueError("epochs must be positive")
    if not 0 < warmup < decay:
        raise ValueError("warm-up steps must lie between 0 and the steps of decay")
    return math.ceil(math.ceil(math.ceil(records / workers) / batch) / accumulation)


def as_dict(settings: Evaluation) -> dict:
    return asdict(settings)
