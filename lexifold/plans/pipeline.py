"""Stage pipelines: a JSON list of [name, arguments] becomes one lazily evaluated plan.

A stage is a function DataFrame -> DataFrame registered under a name; its
arguments are coerced to the types its signature gives. Order-sensitive stages
follow the order columns of the context.
"""

from __future__ import annotations

import inspect
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expressions import compile_condition

REGISTRY: dict = {}


def stage(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


@dataclass
class Context:
    """What the stages of one run share: named tables, constants, stored pipelines, order columns."""

    named: dict = field(default_factory=dict)
    constants: dict = field(default_factory=dict)
    tasks: dict = field(default_factory=dict)
    order: tuple = ("source", "source_page", "id")
    variables: dict = field(default_factory=dict)


def spec(name: str) -> dict:
    """A stage's description: its text and its arguments with types and defaults."""
    f = REGISTRY[name]
    args = [p for p in inspect.signature(f).parameters.values() if p.name not in ("df", "ctx")]
    return {
        "name": name,
        "doc": inspect.getdoc(f) or "",
        "args": [{"name": p.name, "type": str(p.annotation if p.annotation is not p.empty else "str"), **({} if p.default is p.empty else {"default": p.default})} for p in args],
    }


def _coerce(ctx: Context, f, args: dict) -> dict:
    out = {}
    for p in inspect.signature(f).parameters.values():
        if p.name not in args or args[p.name] is None:
            continue
        v = args[p.name]
        if isinstance(v, str) and v.startswith("CONST:"):
            v = ctx.constants[v[6:]]
        kind = p.annotation if isinstance(p.annotation, str) else getattr(p.annotation, "__name__", "")
        if isinstance(v, str):
            v = int(v) if kind == "int" else float(v) if kind == "float" else v.strip().lower() in ("1", "true", "yes", "on") if kind == "bool" else v
            v = [x for x in v.split("\n") if x.strip()] if kind == "list" else v
        out[p.name] = v
    return out


def compile_pipeline(df: DataFrame, steps, ctx: Context | None = None) -> DataFrame:
    """Applies the steps (a list, or its JSON) in order."""
    ctx = ctx or Context()
    for name, args in json.loads(steps) if isinstance(steps, str) else steps:
        f = REGISTRY.get(name)
        if f is None:
            raise ValueError(f"no stage {name!r}")
        kwargs = _coerce(ctx, f, args or {})
        if "ctx" in inspect.signature(f).parameters:
            kwargs["ctx"] = ctx
        df = f(df, **kwargs)
    return df


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@stage("Condition")
def condition(df: DataFrame, cond: str, iftrue: list = (), iffalse: list = (), ctx: Context = None) -> DataFrame:
    """Rows that meet cond take one branch, the others (and null) the other; both go on together."""
    test = compile_condition(df, cond, ctx.variables)
    return union_all([compile_pipeline(df.where(test), iftrue, ctx), compile_pipeline(df.where(~test), iffalse, ctx)])


@stage("ForEach")
def for_each(df: DataFrame, field: str, as_name: str, pipeline: list = (), ctx: Context = None) -> DataFrame:
    """For each element of an array field the row, with the element as as_name, takes the pipeline; the row itself comes too."""
    from .expressions import compile_value

    body = df.withColumn(as_name, F.explode(compile_value(df, field, ctx.variables)))
    return union_all([compile_pipeline(body, pipeline, ctx), df])


@stage("RepeatWhile")
def repeat_while(df: DataFrame, cond: str = "true", times: int = 1, pipeline: list = (), ctx: Context = None) -> DataFrame:
    """The pipeline is applied to rows as long as they meet cond, at most `times` times."""
    done = []
    for _ in range(times):
        test = compile_condition(df, cond, ctx.variables)
        done.append(df.where(~test))
        df = compile_pipeline(df.where(test), pipeline, ctx)
    return union_all([*done, df])


def _override(steps, params: dict):
    """steps with arguments replaced by dotted paths: 2.cond, or 1.iftrue.0.pattern in a branch."""
    steps = json.loads(json.dumps(steps))
    for path, value in params.items():
        at, *rest = path.split(".")
        args = steps[int(at)][1]
        while len(rest) > 1 and isinstance(args.get(rest[0]), list):
            args, rest = args[rest[0]][int(rest[1])][1], rest[2:]
        args[rest[0]] = value
    return steps


@stage("CallTask")
def call_task(df: DataFrame, task: str, skip: int = 0, params: dict = None, ctx: Context = None) -> DataFrame:
    """A stored pipeline in this place, without its first `skip` stages, with some arguments replaced."""
    steps = ctx.tasks[task]
    steps = json.loads(steps) if isinstance(steps, str) else steps
    return compile_pipeline(df, _override(steps, params or {})[skip:], ctx)


@stage("RunTask")
def run_task(df: DataFrame, task: str, ctx: Context = None) -> DataFrame:
    """Another stored pipeline over the same rows, kept under its name; the rows go on as they are."""
    ctx.named[task] = call_task(df, task, ctx=ctx)
    return df


@stage("AggregateDataSource")
def aggregate_sources(df: DataFrame, pipelines: list = (), ctx: Context = None) -> DataFrame:
    """The same rows through several pipelines, one result after the other."""
    return union_all([compile_pipeline(df, p, ctx) for p in pipelines])


@stage("SetNamedResult")
def set_named(df: DataFrame, name: str, ctx: Context = None) -> DataFrame:
    ctx.named[name] = df
    return df


@stage("LoadNamedResult")
def load_named(df: DataFrame, name: str, ctx: Context = None) -> DataFrame:
    return ctx.named[name]
