"""Scalar functions as Column expressions, without Python workers.

Functions of arrays are interpreted by the JVM element by element; for many vectors use the matrix blocks
of ``loomgraph.operators.vectors``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(since: Column, as_of: Column) -> Column:
    """Whole days, at least 0."""
    return F.greatest(F.floor((F.unix_micros(as_of) - F.unix_micros(since)) / 86_400_000_000), F.lit(0)).cast("long")


def decay_factor(age: Column, rate: float = 0.01, floor: float = 0.5) -> Column:
    return F.greatest(1.0 - rate * age, F.lit(floor))


def effective_strength(base: Column, evidence: Column, success: Column, age: Column) -> Column:
    """Base plus a bounded evidence boost, scaled by success (1 if unknown) and by age, within [0, 1]."""
    boost = F.least(0.05 * F.sqrt(F.greatest(evidence - 1, F.lit(0)).cast("double")), F.lit(0.2))
    scaled = (base + boost) * (0.5 + 0.5 * F.coalesce(success, F.lit(1.0))) * decay_factor(age)
    return F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))


def reinforced(strength: Column, uses: Column) -> Column:
    """Strength raised by use, at most 1."""
    return F.least(strength + 0.05 * F.sqrt(uses.cast("double")), F.lit(1.0))


def derived_confidence(superseded: Column, validations: Column, counter: Column) -> Column:
    """0.8 raised or lowered by 0.05 for each validation or counter evidence; 0.1 at least and if superseded."""
    free = F.greatest(F.least(0.8 + 0.05 * validations - 0.05 * counter, F.lit(1.0)), F.lit(0.1))
    return F.when(superseded, F.lit(0.1)).otherwise(free)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length in double precision; 0 if a vector is zero."""
    a, b = (x.cast("array<double>") for x in (a, b))
    size = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, size), F.slice(b, 1, size)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def normalized_tags(tags: Column) -> Column:
    """Trimmed, lower case, without empty ones, first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


# Words of legal forms that names are stripped of.
LEGAL_FORMS = "inc incorporated llc llp ltd limited corp corporation co company gmbh ag sa plc pty pvt".split()


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def without_legal_forms(name: Column) -> Column:
    """Lower-case words, trimmed of dots, without those of legal forms."""
    cleaned = F.transform(words(name), lambda w: F.lower(F.regexp_replace(w, r"^\.+|\.+$", "")))
    return F.array_join(F.filter(cleaned, lambda w: ~w.isin(*LEGAL_FORMS)), " ")


def token_set(text: Column) -> Column:
    trimmed = F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{Alnum}\p{IsAlphabetic}]+|[^\p{Alnum}\p{IsAlphabetic}]+$", "")))
    return F.array_distinct(F.filter(trimmed, lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common words; 1 if both have none and 0 if one has none."""
    x, y = token_set(a), token_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def blocking_keys(name: Column, attributes: Column) -> Column:
    """Sorted distinct keys: three letters of the name, its words, and words of attribute values."""
    stripped = without_legal_forms(name)
    prefix = F.filter(F.array(F.concat(F.lit("p:"), F.substring(stripped, 1, 3))), lambda k: F.trim(F.substring(k, 3, 3)) != "")
    tokens = F.transform(words(stripped), lambda w: F.concat(F.lit("t:"), w))
    pairs = F.flatten(F.transform(F.map_entries(attributes), lambda e: F.transform(words(e["value"]), lambda w: F.concat(F.lit("a:"), e["key"], F.lit(":"), w))))
    return F.array_sort(F.array_distinct(F.concat(prefix, tokens, F.coalesce(pairs, F.array().cast("array<string>")))))


def framed(domain: str, *parts: Column) -> Column:
    """Parts after a domain, each after its length, so different lists never read alike."""
    pieces = [F.lit(domain)]
    for p in parts:
        text = F.coalesce(p.cast("string"), F.lit(""))
        pieces += [F.lit("|"), F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.concat(*pieces)


def derived_id(domain: str, *parts: Column) -> Column:
    """128 bits as 32 hex digits from framed parts."""
    return F.substring(F.sha2(framed(domain, *parts), 256), 1, 32)


def schema_hash(columns: Column) -> Column:
    """Digest of (name, type) structs that does not depend on their order."""
    lines = F.transform(columns, lambda c: F.concat(c["name"], F.lit("\n"), c["type"], F.lit("\n")))
    return F.sha2(F.array_join(F.array_sort(lines), ""), 256)


def percent_decoded(text: Column) -> Column:
    """Percent escapes read back; a plus stays a plus."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def bounded_text(text: Column, limit: int, notice: str) -> Column:
    """The first ``limit`` characters, with a notice if there were more."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(notice))).otherwise(text)


def title_of(text: Column, limit: int = 200) -> Column:
    return F.substring(text, 1, limit)


def session_key(uri: Column) -> Column:
    """The key of a session://key address, or an empty string."""
    return F.regexp_extract(uri, r"^session://([A-Za-z0-9_.-]+)$", 1)


def similarity_advice(new_type: Column, old_type: Column, new_text: Column, old_text: Column) -> Column:
    return F.when(new_type != old_type, "contradicts").when(new_text == old_text, "duplicate").otherwise("replaces")


# Quality that each kind of discovery is proposed with.
DISCOVERY_QUALITY = {"CrossDomain": 0.9, "TemporalEcho": 0.7, "Orphan": 0.4, "Transitive": 0.6}


def discovery_quality(kind: Column) -> Column:
    value = F.lit(None).cast("double")
    for name, quality in DISCOVERY_QUALITY.items():
        value = F.when(kind == name, F.lit(quality)).otherwise(value)
    return value


def provenance_label(kind: Column) -> Column:
    """How a row came about, for display."""
    return F.when(kind.isin("Asserted", "Extracted"), "observed").when(kind.isin("Derived", "Computed"), "inferred").when(kind == "Proposed", "proposed").otherwise("imported")


def cell_text(value: Column) -> Column:
    """A JSON cell as text; JSON null is null."""
    return F.when(value == "null", F.lit(None)).otherwise(value)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The HMAC-SHA256 of a message's bytes in lower-case hex; null for a null message."""
    import hashlib

    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def verified(key: bytes, message: Column, signature: Column) -> Column:
    """Whether a signature is the message's; a missing or empty one is not."""
    return F.coalesce(F.lower(signature) == hmac_sha256(key, message), F.lit(False))


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a of a text's UTF-8 bytes, as decimal(20,0); decimals hold the products that wrap."""
    number = lambda digits: F.lit(digits).cast(f"decimal({len(digits)},0)")

    def step(state: Column, byte: Column) -> Column:
        low = F.pmod(state, F.lit(256)).cast("int")
        mixed = (state - low + low.bitwiseXOR(F.conv(byte, 16, 10).cast("int"))).cast("decimal(20,0)")
        return ((mixed * number("1099511628211")) % number("18446744073709551616")).cast("decimal(20,0)")

    digits = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1))
    return F.aggregate(digits, number("14695981039346656037").cast("decimal(20,0)"), step)
