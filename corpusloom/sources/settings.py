"""Users, domain rules and model profiles from parsed configuration (YAML or JSON mappings), all problems at once."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class SettingsError(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


# The patterns that hold where an organisation brings none.
BOILERPLATE = (r"^©", r"^copyright\b", r"^confidential information\b", r"^all rights reserved\b", r"^this document is provided for information purpose", r"^without prior written authori[sz]ation")
REFERENCES = (r"\bKB\d{6,}\b",)


@dataclass(frozen=True)
class Domain:
    """Patterns an organisation brings: boilerplate lines, commands, article ids."""

    boilerplate: tuple[str, ...] = BOILERPLATE
    commands: tuple[str, ...] = ()
    references: tuple[str, ...] = REFERENCES


def domain(given: dict) -> Domain:
    """A key replaces its default; unknown keys and patterns that do not compile are problems."""
    problems = [f"unknown key {k!r}" for k in given if k not in Domain.__dataclass_fields__]
    for key, patterns in given.items():
        for p in patterns if key in Domain.__dataclass_fields__ else ():
            try:
                re.compile(p)
            except re.error as e:
                problems.append(f"{key}: {p!r} does not compile ({e})")
    if problems:
        raise SettingsError(problems)
    return Domain(**{k: tuple(v) for k, v in given.items()})


def users(spark: SparkSession, given: dict) -> DataFrame:
    """user_id, name, groups (with 'all'), is_default."""
    people, problems = given.get("users") or {}, []
    rows = []
    for user, about in people.items():
        groups = [g for g in (about or {}).get("groups") or [] if g != "all"]
        problems += [f"user {user!r}: group {g!r} must be lowercase" for g in groups if not re.fullmatch("[a-z0-9][a-z0-9_-]*", str(g))]
        rows.append((user, (about or {}).get("name") or user, [*groups, "all"], user == given.get("default_user")))
    if given.get("default_user") not in people:
        problems.append("default_user is not a user")
    if problems:
        raise SettingsError(problems)
    return spark.createDataFrame(rows, "user_id string, name string, groups array<string>, is_default boolean")


def resolve_user(directory: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(qid, user_id) with groups; no name is the default user, an unknown one gets no row."""
    from pyspark.sql import functions as F

    default = directory.where("is_default").select(F.col("user_id").alias("_d")).scalar()
    return requests.withColumn("user_id", F.coalesce("user_id", default)).join(directory.select("user_id", "groups"), "user_id")


@dataclass(frozen=True)
class Profile:
    name: str
    provider: str
    model: str
    external: bool = False
    api_key: str | None = None
    context_tokens: int = 8_192
    max_output_tokens: int = 1_500
    fallback: str | None = None


@dataclass
class Catalogue:
    profiles: dict[str, Profile] = field(default_factory=dict)

    def chain(self, name: str) -> list[Profile]:
        made = []
        while name and len(made) <= len(self.profiles):
            made.append(self.profiles[name])
            name = self.profiles[name].fallback
        return made

    def frame(self, spark: SparkSession, keys: set[str] = frozenset()) -> DataFrame:
        """name, fallback, external, ready, as answers.fallback_chain takes them."""
        rows = [(p.name, p.fallback, p.external, not p.api_key or p.api_key in keys) for p in self.profiles.values()]
        return spark.createDataFrame(rows, "name string, fallback string, external boolean, ready boolean")


def catalogue(given: dict) -> Catalogue:
    """Profiles by name; an external one names its key, fallbacks exist, end locally and do not go round."""
    problems, made = [], {}
    known = set(Profile.__dataclass_fields__) - {"name"}
    for name, about in (given.get("models") or {}).items():
        problems += [f"{name}: unknown key {k!r}" for k in about if k not in known]
        p = made[name] = Profile(name=name, **{"provider": "", "model": "", **{k: v for k, v in about.items() if k in known}})
        if p.external and not p.api_key:
            problems.append(f"{name}: an external model names the variable of its key")
        if p.context_tokens < 1_024 or p.max_output_tokens >= p.context_tokens:
            problems.append(f"{name}: output must be less than a context of at least 1024")
    for p in made.values():
        if p.fallback and p.fallback not in made:
            problems.append(f"{p.name}: fallback {p.fallback!r} is not a model")
        seen, at = [], p
        while at.fallback in made and at.name not in seen:
            seen.append(at.name)
            at = made[at.fallback]
        if at.name in seen:
            problems.append(f"{p.name}: fallbacks go round")
        elif p.external and p.fallback and at.external:
            problems.append(f"{p.name}: the last fallback must be local")
    if problems:
        raise SettingsError(problems)
    return Catalogue(made)
