"""A job's configuration: strict sections, read from JSON with comments.

Sections ``browser`` and ``assist`` are read and checked, so that job files stay portable; nothing here drives a browser or asks a model.
"""

from __future__ import annotations

from pathlib import Path
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict, Field, field_validator, model_validator

from .plans.extract import Options
from .plans.job import Plan
from .plans.sinks import infer_format
from .sources.load import jsonc

# The sections' keys, defaults and ranges, as job files have them.


class Section(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True)


class Sources(Section):
    type: Literal["url", "urls", "file", "stdin"] = "url"
    url: str | None = None
    urls: list[str] = []
    path: Path | None = None
    archive: str | None = None

    @model_validator(mode="after")
    def file_has_a_path(self) -> Sources:
        if self.type == "file" and not self.path:
            raise ValueError("sources of type file need a path")
        return self


class Browser(Section):
    enabled: bool = True
    headless: bool = True
    timeout: int = Field(30_000, ge=1_000, le=600_000)
    concurrency: int = Field(4, ge=1, le=32)
    wait_until: Literal["load", "domcontentloaded", "networkidle", "commit"] = "domcontentloaded"
    wait_for: str | None = None
    wait_ms: int = Field(0, ge=0, le=120_000)
    user_agent: str | None = None
    viewport: tuple[int, int] = (1366, 900)
    locale: str | None = None
    timezone: str | None = None
    block_resources: list[Literal["font", "media", "image", "stylesheet", "script", "xhr", "fetch", "websocket", "other"]] = ["font", "media"]
    block_images: bool = False
    persist_cookies: bool = True
    storage_state: Path | None = None
    executable_path: Path | None = None
    extra_headers: dict[str, str] = {}


class Spec(Section):
    """Where a field comes from: a selector, an attribute or pattern of it, a constant, or another field."""

    mode: Literal["auto", "selector", "attribute", "regex", "constant", "field"] = "auto"
    selector: str | None = None
    attribute: str | None = None
    regex: str | None = None
    value: Any = None
    field: str | None = None
    type: Literal["auto", "string", "number", "integer", "boolean", "url", "date", "datetime"] = "auto"
    required: bool = False
    many: bool = False
    default: Any = None

    @model_validator(mode="before")
    @classmethod
    def widen(cls, given: Any) -> Any:
        """``"auto"`` and selectors may stand for the object, and the object's keys tell its mode."""
        if isinstance(given, str):
            return {"mode": "auto"} if given == "auto" else {"mode": "selector", "selector": given}
        if isinstance(given, dict) and "mode" not in given:
            told = (("field", "field"), ("regex", "regex"), ("attribute", "attribute"), ("selector", "selector"))
            mode = next((m for k, m in told if given.get(k)), "constant" if given.get("value") is not None else "auto")
            return given | {"mode": mode}
        return given

    @model_validator(mode="after")
    def has_what_its_mode_needs(self) -> Spec:
        needs = {"selector": ("selector",), "attribute": ("selector", "attribute"), "field": ("field",), "regex": ("regex",)}
        if missing := [k for k in needs.get(self.mode, ()) if not getattr(self, k)]:
            raise ValueError(f"mode {self.mode} needs {missing[0]}")
        return self

    def plan(self) -> dict[str, Any] | None:
        """The spec as ``extract.configured`` takes it; none for what needs no lookup."""
        if self.mode in ("auto", "field"):
            return None
        keys = {"selector": ("selector",), "attribute": ("selector", "attribute"), "regex": ("selector", "attribute", "regex"), "constant": ("value",)}[self.mode]
        out = {k: getattr(self, k) for k in keys if getattr(self, k) is not None}
        if "value" in out:
            out["value"] = str(out["value"]).lower() if isinstance(out["value"], bool) else str(out["value"])
        return out | ({"default": str(self.default)} if self.default is not None else {}) | ({"many": True} if self.many else {})


class Extraction(Section):
    mode: Literal["auto", "manual"] = "auto"
    collection: str | None = None
    fields: dict[str, Spec] = {}
    min_confidence: float = Field(0.0, ge=0, le=1)
    min_records: int = Field(2, ge=1)
    max_records_per_page: int = Field(5000, ge=1)
    include_structured_data: bool = True
    include_tables: bool = True
    provenance: bool = False
    required: list[str] = []


class Pagination(Section):
    enabled: bool = True
    selector: str | None = None
    url_template: str | None = None
    max_pages: int = Field(25, ge=1, le=10_000)
    infinite_scroll: bool = False
    max_scrolls: int = Field(20, ge=0, le=500)
    max_items: int = Field(10_000, ge=1)
    max_duration_s: int = Field(300, ge=1)
    stop_on_duplicate_page: bool = True


class Dedupe(Section):
    enabled: bool = True
    keys: list[str] = []
    scope: Literal["job", "source", "page"] = "job"


class Retry(Section):
    attempts: int = Field(3, ge=1, le=10)
    base_delay_s: float = Field(1.0, ge=0)
    max_delay_s: float = Field(30.0, ge=0)
    jitter: float = Field(0.25, ge=0, le=1)


class Politeness(Section):
    delay_s: float = Field(0.0, ge=0, le=60)
    respect_robots: bool = True
    obey_crawl_delay: bool = True
    per_host: int = Field(2, ge=1, le=32)
    user_agent_note: str | None = None


class Follow(Section):
    enabled: bool = False
    field: str = "url"
    max_pages: int = Field(200, ge=1, le=100_000)
    prefer: Literal["detail", "listing"] = "detail"
    same_host: bool = True


class Assist(Section):
    provider: Literal["null", "openai_compatible", "command", "anthropic"] = "null"
    model: str = ""
    base_url: str | None = None
    api_key_env: str | None = None
    command: list[str] = []
    tier: Literal["schema", "json", "text"] = "json"
    min_coverage: float = Field(0.8, ge=0, le=1)
    max_fields: int = Field(24, ge=1, le=200)
    cache: bool = True
    timeout_s: float = Field(60.0, gt=0, le=600)


class Output(Section):
    format: Literal["json", "jsonl", "csv", "sqlite"] | None = None
    path: Path | None = None
    provenance: bool = False
    pretty: bool = True
    csv_delimiter: str = ","
    columns: list[str] = []

    @property
    def kind(self) -> str | None:
        return self.format or infer_format(self.path)


class Config(Section):
    name: str | None = None
    sources: Sources = Sources()
    browser: Browser = Browser()
    extraction: Extraction = Extraction()
    pagination: Pagination = Pagination()
    dedupe: Dedupe = Dedupe()
    retry: Retry = Retry()
    politeness: Politeness = Politeness()
    follow: Follow = Follow()
    assist: Assist = Assist()
    output: Output = Output()
    concurrency: int = Field(4, ge=1, le=64)
    acquirer: Literal["auto", "browser", "http", "file"] = "auto"
    db: Path | None = None

    @field_validator("acquirer")
    @classmethod
    def no_browser(cls, name: str) -> str:
        if name == "browser":
            raise ValueError("there is no browser here; pages come from files, archives and HTTP")
        return name

    # End of fixed values.

    def merged(self, patch: dict[str, Any]) -> Config:
        """With parts of it replaced, at any depth."""

        def over(base: dict, new: dict) -> dict:
            return base | {k: over(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in new.items() if v is not None}

        return Config.model_validate(over(self.model_dump(exclude_defaults=True), patch))

    def options(self) -> Options:
        e = self.extraction
        specs = {k: plan for k, s in e.fields.items() if (plan := s.plan()) is not None}
        renames = {s.field: k for k, s in e.fields.items() if s.mode == "field" and s.field}
        types = {k: s.type for k, s in e.fields.items() if s.type != "auto"}
        return Options(
            collection=e.collection, fields=specs, wanted=list(e.fields) or None, renames=renames, types=types, required=[*e.required, *[k for k, s in e.fields.items() if s.required]],
            min_confidence=e.min_confidence, min_records=e.min_records, max_records_per_page=e.max_records_per_page, include_tables=e.include_tables, include_structured=e.include_structured_data,
        )

    def plan(self) -> Plan:
        p, f = self.pagination, self.follow
        return Plan(
            options=self.options(), paginate=p.enabled, max_pages=p.max_pages, max_items=p.max_items, next_selector=p.selector, url_template=p.url_template,
            stop_on_duplicate_page=p.stop_on_duplicate_page, follow=f.enabled, follow_field=f.field, follow_pages=f.max_pages, prefer=f.prefer, same_host=f.same_host,
            dedupe=self.dedupe.enabled, keys=tuple(self.dedupe.keys), scope=self.dedupe.scope, respect_robots=self.politeness.respect_robots,
        )


def load(path: str | Path) -> Config:
    path = Path(path)
    if path.suffix not in (".json", ".jsonc", ".json5"):
        raise ValueError(f"{path}: not a JSON file")
    return Config.model_validate(jsonc(path.read_text(encoding="utf-8")))
