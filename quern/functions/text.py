"""Text rules as Column expressions: slugs, layers, secrets, note lines, names, ages, versions, reset times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of secrets.
SECRETS = (
    r"(?i)\bsk-[A-Za-z0-9_\-]{8,}",
    r"\bgh[posru]_[A-Za-z0-9]{8,}",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    r"\beyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]*",
    r"\bBearer\s+[A-Za-z0-9._~+/=\-]{12,}",
    r"\bAKIA[0-9A-Z]{12,}",
    r"(?i)\bAWS_SECRET_ACCESS_KEY\b",
    r"-----BEGIN\b",
    r"(?i)\b[\w-]*(?:secret|token|api[_-]?key|password|passwd|access[_-]?key)[\w-]*\s*[=:]\s*\S+",
    r"(?i)\b(?:password|passwd)\b(?:\s+is)?\s+\S+",
    r"(?i)\btoken\s+is\s+\S+",
)
#: Phrasings of layers and of note lines.
WHEN = r"(?i)^\s*(?:when|whenever|before|after|during)\b"
LOCATION = r"(?i)\b(?:repo|project|code|files?|directory|dir)\b.*\blives?\b"
ALWAYS = r"(?i)^\s*(?:always|never|don'?t|do not|prefer|use)\b"
NOTES = (
    r"(?i)^\s*(?:[-*]\s+)?(?:remember|don't forget|note|todo|fyi)[:\s]\s*(.+)$",
    r"(?i)^\s*(?:[-*]\s+)?(?:decision|chose|going with)[:\s]\s*(.+)$",
    r"(?i)^\s*(?:[-*]\s+)?(?:prefer|use|don't use|avoid)\s+(.+)$",
    r"(?i)^\s*(?:[-*]\s+)?(?:you forgot|i told you|i said)\s+(.+)$",
)
#: Standing probes, the shape of reset times, codes and phrases of limits.
PROBES = ("we always do this", "I prefer", "the convention is", "we decided to", "don't do this", "never do this", "the repo lives in", "the project lives at", "always use", "make sure you", "remember to", "going forward")
RESET = r"(?i)resets\s+(?:(mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+)?(\d{1,2}):(\d{2})\s*(am|pm)?"

LIMIT_CODES = r"rate_limit|billing_error|usage_limit"
LIMIT_WORDS = r"reached your|usage limit|rate limit|resets"


def like(text: Column, pattern: str) -> Column:
    """Whether a pattern is found, with letters, blanks and case of all of Unicode."""
    return text.rlike(f"(?U){pattern}")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def cache_key(text: Column) -> Column:
    """Sixteen hexadecimal digits that name a text's vector in a cache."""
    return F.substring(F.sha2(text, 256), 1, 16)


def slug(path: Column) -> Column:
    """Project slug of a path: its last segment in lower case, other characters as single dashes; else `unknown`."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("unknown"))


def slugify(title: Column, most: int, default: str) -> Column:
    """A title as a file name of at most `most` characters."""
    return F.coalesce(F.nullif(F.btrim(F.substring(F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-")), 1, most), F.lit("-")), F.lit("")), F.lit(default))


def has_secret(text: Column) -> Column:
    """Whether a text has one of SECRETS. Two plain patterns, of which every shape has a part, leave most texts out first.

    The long s is the only letter that equals one of theirs in any case and has another lower case; a dotted capital I
    becomes two characters.
    """
    hinted = F.lower(text).rlike(r"sk-|secret|token|passw|ap\S{1,2}[_-]?key|access[_-]?key") | text.rlike("gh[posru]_|xox|eyJ|Bearer|AKIA|-----BEGIN|\u017f")
    found = F.lit(False)
    for shape in SECRETS:
        found = found | like(text, shape)
    return hinted & found


def layer_guess(text: Column) -> Column:
    """Layer of a candidate: secrets are knowledge, then when-, location- and always-phrasings, else knowledge."""
    living = F.lower(text).rlike(r"l\S{1,2}ve") & like(text, LOCATION)  # a plain pattern first, that all of these fit
    return F.when(has_secret(text), "knowledge").when(like(text, WHEN), "when").when(living, "topic").when(like(text, ALWAYS), "always").otherwise("knowledge")


def note_line(line: Column) -> Column:
    """The note of a line by the first family that matches, without final periods; null where none does."""
    return F.coalesce(*[F.when(like(line, p), F.rtrim(stripped(F.regexp_extract(line, f"(?U){p}", 1)), F.lit("."))) for p in NOTES])


def suggested_name(text: Column) -> Column:
    first = stripped(F.regexp_extract(stripped(text), r"^([^.\n!?]*)", 1))
    return F.when(F.length(first) > 70, F.concat(F.substring(first, 1, 70), F.lit("…"))).when(first == "", "untitled").otherwise(first)


def frontmatter(text: Column) -> Column:
    return F.struct(layer_guess(text).alias("type"), suggested_name(text).alias("name"), F.btrim(text, F.lit(" \n\r\t")).alias("description"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("aliases"))


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.btrim(text, F.lit(" \n\r\t")), "[\r\n]+", " ↵ ")


def safe_name(name: Column) -> Column:
    """A name in quotes if it is plain, else a marker to edit: nothing that a shell would run."""
    return F.when(name.rlike(r"^[\p{L}\p{N}_ .,\-/]+$"), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.lit('"<edit before running>"'))


def capture_command(text: Column, program: str = "quern") -> Column:
    name = suggested_name(text)
    return F.concat(F.lit(f"{program} capture --layer "), layer_guess(text), F.lit(" --file "), slugify(name, 50, "candidate"), F.lit(".md --name "), safe_name(name), F.lit(' --description "..."'))


def active_commands(review: Column) -> Column:
    """Commands of a review's unticked items, up to its deferred part."""
    active = F.regexp_extract(review, r"(?s)^(.*?)(?:\n## Deferred|$)", 1)
    return F.regexp_extract_all(active, F.lit(r"capture: `([^`]+)`"), F.lit(1))


def relative_age(days: Column) -> Column:
    def phrase(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    each = lambda size: F.floor(days / size).cast("int")
    return F.when(days <= 0, "today").when(days < 7, phrase(days, "day")).when(days < 30, phrase(each(7), "week")).when(days < 365, phrase(each(30), "month")).otherwise(phrase(each(365), "year"))


def snippet(text: Column, chars: int = 300, lines: int = 3) -> Column:
    """The first characters of the first lines."""
    return F.array_join(F.slice(F.split(F.substring(text, 1, chars), "\n"), 1, lines), "\n")


def version(tag: Column) -> Column:
    """(major, minor, patch) of a tag; null where it is none."""
    p = r"^v?(\d+)\.(\d+)\.(\d+)$"
    return F.when(tag.rlike(p), F.struct(*[F.regexp_extract(tag, p, i + 1).cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def is_limit(code: Column, message: Column) -> Column:
    """A stop that looks like a usage limit: a known code, or a message of a limit that is worded like one."""
    said = F.lower(F.coalesce(message, F.lit("")))
    return F.lower(F.coalesce(code, F.lit(""))).rlike(LIMIT_CODES) | said.contains("limit") & said.rlike(LIMIT_WORDS)


def reset_time(message: Column, base: Column) -> Column:
    """The next time after base that a message like "resets Mon 3:45pm" names; null where it names none."""
    day, half = F.lower(F.regexp_extract(message, RESET, 1)), F.lower(F.regexp_extract(message, RESET, 4))
    hour, minute = F.regexp_extract(message, RESET, 2).try_cast("int"), F.regexp_extract(message, RESET, 3).try_cast("int")
    hour = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    days = {d: i for i, d in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))}
    target = F.lit(None).cast("int")
    for d, i in days.items():
        target = F.when(day == d, F.lit(i)).otherwise(target)
    ahead = F.when(target.isNull(), F.lit(0)).otherwise(F.pmod(target - F.weekday(base), F.lit(7)))
    at = F.date_trunc("day", base) + F.make_interval(days=ahead, hours=hour, mins=minute)
    late = F.when(target.isNull(), F.lit(1)).otherwise(F.lit(7))
    return F.when((hour <= 23) & (minute <= 59), F.when(at <= base, at + F.make_interval(days=late)).otherwise(at))
