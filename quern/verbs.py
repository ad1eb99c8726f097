"""Verbs on single files and small state: notes, tasks, include scope, bootstrap plans, rendered results.

These are one file at a time, so they run on the driver, through the session's file systems; what is large stays in
tables. New files are written whole or not at all, changed ones are put in place by a rename after a second look.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession

from quern import store
from quern.config import LAYER_DIRS, TASK_STATES

#: Fixed value: how often a change is tried again after another writer was first.
TRIES = 3
PLAN_VERSION = 1
#: Folder names of services that copy what lies in them elsewhere.
CLOUD = {"com~apple~CloudDocs": "iCloud Drive", "Mobile Documents": "iCloud Drive", "Dropbox": "Dropbox", "Google Drive": "Google Drive", "OneDrive": "OneDrive"}


def split_note(text: str) -> tuple[dict, str]:
    """Frontmatter and body of a note."""
    import yaml

    parts = text.split("\n---", 1)
    if not text.startswith("---\n") or len(parts) < 2:
        raise ValueError("the file has no frontmatter")
    return yaml.safe_load(parts[0][3:]) or {}, parts[1].lstrip("-").removeprefix("\n")


def join_note(meta: dict, body: str) -> str:
    import yaml

    return f"---\n{yaml.dump(meta, default_flow_style=False, allow_unicode=True, sort_keys=False)}---\n{body}"


def changed(spark: SparkSession, path: str, change: Callable[[str], str]) -> str:
    """Reads a file, changes it and puts it back unless another writer came between; then it is tried again."""
    for _ in range(TRIES):
        if not store.exists(spark, path):
            raise FileNotFoundError(path)
        old = store.read_small(spark, path)
        new = change(old)
        if hashlib.sha256(store.read_small(spark, path).encode()).digest() == hashlib.sha256(old.encode()).digest():
            store.replace(spark, path, new.encode())
            return new
    raise RuntimeError(f"other writers of {path} were first {TRIES} times")


# -------------------------------------------------------------------------------- notes


def note_text(layer: str, name: str, description: str, now: dt.datetime, body: str | None = None, tags: list[str] = (), aliases: list[str] = (), valid_from: str | None = None) -> str:
    stamp = now.isoformat(timespec="seconds")
    meta = {"name": name, "description": description, "type": layer, "tags": list(tags), "aliases": list(aliases), "created": stamp, "updated": stamp, "valid_from": valid_from or now.date().isoformat()}
    return join_note(meta, "\n" + (body or f"# {name}\n\n{description}\n"))


def note_path(home: str, layer: str, filename: str, project: str | None = None) -> str:
    if layer not in LAYER_DIRS:
        raise ValueError(f"layer is one of {sorted(LAYER_DIRS)}")
    for part in (filename, project or "p"):
        if not part or "/" in part or part.startswith("."):
            raise ValueError(f"{part!r} is no plain name")
    if project and not project.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"{project!r} is no project slug")
    return f"{home.rstrip('/')}/{f'projects/{project}/' if project else ''}{LAYER_DIRS[layer]}/{filename}"


def confirm_note(spark: SparkSession, path: str, today: dt.date) -> str:
    """Confirmed today, suspicion cleared; every other key stays."""

    def change(text: str) -> str:
        meta, body = split_note(text)
        return join_note({k: v for k, v in meta.items() if k not in ("suspected_at", "suspect_reason")} | {"last_confirmed": today.isoformat()}, body)

    return changed(spark, path, change)


def suspect_note(spark: SparkSession, path: str, now: dt.datetime, reason: str | None = None) -> str:
    """Suspected from now, with the reason or without the old one; an invalidated note is refused."""

    def change(text: str) -> str:
        meta, body = split_note(text)
        if meta.get("invalidated_at"):
            raise ValueError(f"{path} is invalidated already")
        kept = {k: v for k, v in meta.items() if k != "suspect_reason"} | {"suspected_at": now.isoformat()}
        return join_note(kept | ({"suspect_reason": reason} if reason else {}), body)

    return changed(spark, path, change)


def invalidate_note(spark: SparkSession, path: str, now: dt.datetime, at: str | None = None, reason: str | None = None) -> str:
    """Invalidated, with the reason appended to the body; one that is already is refused."""

    def change(text: str) -> str:
        meta, body = split_note(text)
        if meta.get("invalidated_at"):
            raise ValueError(f"{path} is invalidated already")
        return join_note(meta | {"invalidated_at": at or now.isoformat(), "updated": now.date().isoformat()}, body + (f"\n\nInvalidated: {reason}\n" if reason else ""))

    return changed(spark, path, change)


# -------------------------------------------------------------------------------- tasks


def add_task(spark: SparkSession, home: str, task_id: str, title: str, today: dt.date, body: str = "", owner: str = "", links: list[str] = ()) -> str:
    """Creates an open task; an id that is taken gets -2 to -99. Returns the id."""
    meta = {"title": title, "status": "open", "owner_role": owner, "session_id": "", "created": today.isoformat(), "updated": today.isoformat(), "links": list(links)}
    for k in range(1, 100):
        name = task_id if k == 1 else f"{task_id}-{k}"
        if store.create(spark, f"{home.rstrip('/')}/tasks/{name}.md", join_note({"id": name} | meta, "\n" + body).encode()):
            return name
    raise RuntimeError(f"no free id for task {task_id!r}")


def move_task(spark: SparkSession, home: str, task_id: str, verb: str, today: dt.date, session: str = "", reason: str = "") -> dict:
    """start claims the task for a session, done clears the claim, block appends its reason. Returns the new fields."""
    status = {"start": "in_progress", "done": "done", "block": "blocked"}[verb]
    assert status in TASK_STATES

    def change(text: str) -> str:
        meta, body = split_note(text)
        new = meta | {"status": status, "updated": today.isoformat()}
        if verb != "block":
            new["session_id"] = session if verb == "start" else ""
        return join_note(new, body + (f"\n\nBlocked: {reason}\n" if verb == "block" and reason else ""))

    return split_note(changed(spark, f"{home.rstrip('/')}/tasks/{task_id}.md", change))[0]


# -------------------------------------------------------------------------------- include scope


def edit_scope(spark: SparkSession, path: str, add: list[str] = (), remove: list[str] = (), deny: list[str] = (), allow: list[str] = ()) -> dict:
    """Included folders and denied globs of a settings file after an edit, in order of first sight; other keys stay.

    allow takes globs out of the denied ones.
    """
    import yaml

    store.create(spark, path, b"{}\n")  # unless it is there

    def change(text: str) -> str:
        old = yaml.safe_load(text) or {}
        dirs = [d for d in dict.fromkeys([*(old.get("include_dirs") or []), *add]) if d not in set(remove)]
        globs = [g for g in dict.fromkeys([*(old.get("include_deny") or []), *deny]) if g not in set(allow)]
        return yaml.dump(old | {"include_dirs": dirs, "include_deny": globs}, sort_keys=False, allow_unicode=True)

    return yaml.safe_load(changed(spark, path, change))


def scope(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    import yaml

    raw = yaml.safe_load(store.read_small(spark, path)) if store.exists(spark, path) else {}
    return list(raw.get("include_dirs") or []), list(raw.get("include_deny") or [])


# -------------------------------------------------------------------------------- bootstrap plans


def load_plan(spark: SparkSession, path: str) -> dict | None:
    """The plan of a run that was begun; one that cannot be read is an error, never a fresh start."""
    if not store.exists(spark, path):
        return None
    try:
        plan = json.loads(store.read_small(spark, path))
    except ValueError as e:
        raise ValueError(f"the plan {path} is damaged: delete it to begin anew") from e
    if plan.get("version") != PLAN_VERSION:
        raise ValueError(f"the plan {path} has version {plan.get('version')}, not {PLAN_VERSION}")
    return plan


def save_plan(spark: SparkSession, path: str, plan: dict) -> None:
    data = json.dumps(plan, indent=2, sort_keys=True).encode()
    if not store.create(spark, path, data):
        store.replace(spark, path, data)


def open_batches(plan: dict) -> list[str]:
    return [b for b in plan["batches"] if b not in set(plan["completed"])]


def finish_batch(spark: SparkSession, path: str, batch: str) -> dict:
    """Marks a batch as done, once."""
    plan = load_plan(spark, path)
    if plan is None or batch not in plan["batches"]:
        raise ValueError(f"{batch!r} is not in the plan")
    if batch not in plan["completed"]:
        plan["completed"].append(batch)
        save_plan(spark, path, plan)
    return plan


# -------------------------------------------------------------------------------- other


def cloud_of(path: str) -> str | None:
    """The service that a folder's path names, if one does."""
    return next((label for part, label in CLOUD.items() if part in path.split("/")), None)


def render_json(hits: DataFrame) -> str:
    """Results of a search (a few rows) as one JSON object, hits by tier."""
    rows = [json.loads(x) for x in hits.toJSON().collect()]
    return json.dumps({t: [r for r in rows if r["tier"] == t] for t in ("memory", "session")}, ensure_ascii=False, indent=2)


def render_layers(hits: DataFrame, promote: bool = False) -> str:
    """Results of a search as text: tiers apart, best first, a few lines of each hit."""
    rows = sorted(hits.collect(), key=lambda r: (("memory", "session").index(r["tier"]), -r["score"], r["id"]))
    out, seen = [], {"memory": 0, "session": 0}
    for tier, part in groupby(rows, key=lambda r: r["tier"]):
        part = list(part)
        seen[tier] = len(part)
        out.append(f"== {tier}: {len(part)} ==")
        for r in part:
            out.append(f"{r['score']:.3f}  {r['id']}{r['tag'] if 'tag' in r and r['tag'] else ''}")
            out += [f"    {x}" for x in (r["snippet"] or "").strip().splitlines()[:3]]
        out.append("")
    if promote and not seen["memory"] and seen["session"]:
        out.append(f"Only sessions know of this ({seen['session']} hits): worth a note.")
    return "\n".join(out)
