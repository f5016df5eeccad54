"""Functions over identifiers: splitting into words and telling credential names from others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists that decide about a name.
KEY_QUALIFIERS = ("access", "account", "api", "auth", "client", "database", "db", "deploy", "encrypt", "encryption", "gpg", "hmac", "jwt", "license", "loggedin", "master", "mongo", "mysql", "nonce", "pgp", "postgres", "private", "redis", "registry", "secret", "service", "signing", "smtp", "ssh", "ssl", "tls", "webhook")
KEY_DISQUALIFIERS = ("cache", "dummy", "example", "expired", "fake", "invalid", "masked", "placeholder", "redacted", "revoked")
TOKEN_QUALIFIERS = ("access", "account", "api", "app", "auth", "bearer", "bot", "ci", "client", "deploy", "github", "installation", "integration", "machine", "personal", "refresh", "registration", "runner", "service", "session", "webhook")
TOKEN_DISQUALIFIERS = ("dummy", "example", "expired", "fake", "invalid", "masked", "placeholder", "redacted", "revoked")
EXCLUSIONS = ("advice", "algorithm", "change", "changed", "changes", "changing", "dir", "encoding", "file", "forgot", "format", "hash", "hashed", "label", "length", "mandatory", "name", "path", "pattern", "policy", "prefix", "public", "publishable", "regex", "rotation", "size", "success", "successful", "successfully", "suffix", "title", "tooltip", "type", "uri", "url")
DISQUALIFIERS = ("debug", "demo", "deprecated", "disabled", "draft", "dummy", "example", "expired", "fake", "fixture", "inactive", "invalid", "legacy", "masked", "mock", "obsolete", "placeholder", "prototype", "removed", "revoked", "sample", "scratch", "stub", "temp", "temporary", "test", "tmp", "todo", "unused")
STRONG_KEYWORDS = ("authorization", "credential", "credentials", "mnemonic", "passphrase", "passwd", "password", "pwd", "secret", "webhook")
STRONG_PHRASES = ("pin_code", "pin_number")
WEAK_PHRASES = ("security_answer", "security_question")
NONCE_FOLLOWERS = ("key", "salt", "secret", "password", "passphrase", "pwd")


def _list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def name_words(name: Column) -> Column:
    """Lower-case words of an identifier, split at separators and camel-case borders."""
    parted = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(F.lower(parted), r"[^a-z0-9]+"), lambda w: w != "")


def name_kind(words: Column) -> Column:
    """Sensitive, Key, Token or Mnemonic for a credential's name, else null. Earlier rules win."""
    has = lambda wanted: F.arrays_overlap(words, _list(wanted))
    joined, last = F.array_join(words, "_"), F.try_element_at(words, F.lit(-1))
    phrase = lambda phrases: F.exists(_list(phrases), lambda p: F.contains(joined, p))
    after_nonce = F.try_element_at(words, F.array_position(words, "nonce").cast("int") + 1)
    lone_nonce = F.array_contains(words, "nonce") & ~F.coalesce(after_nonce.isin(*NONCE_FOLLOWERS), F.lit(False))
    key = F.array_contains(words, "key") & ~has(KEY_DISQUALIFIERS)
    token = F.array_contains(words, "token") & ~has(TOKEN_DISQUALIFIERS)
    return (
        F.when(F.size(words) == 0, None)
        .when(has(DISQUALIFIERS) | lone_nonce | has(EXCLUSIONS), None)
        .when(F.array_contains(words, "mnemonic"), "Mnemonic")
        .when(joined == "auth", "Sensitive")
        .when(phrase(STRONG_PHRASES) | phrase(WEAK_PHRASES) | has(STRONG_KEYWORDS), "Sensitive")
        .when(key & (has(KEY_QUALIFIERS) | F.contains(joined, F.lit("logged_in"))), "Key")
        .when(token & has(TOKEN_QUALIFIERS), "Token")
        .when(key & (last == "key"), "Key")
        .when(token & (last == "token"), "Token")
    )


def words_sql(name: str) -> str:
    return f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def kind_sql(words: str) -> str:
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    has = lambda xs: f"list_has_any({words}, {listed(xs)})"
    joined = f"array_to_string({words}, '_')"
    phrase = " OR ".join(f"contains({joined}, '{p}')" for p in STRONG_PHRASES + WEAK_PHRASES)
    after = f"coalesce(list_contains({listed(NONCE_FOLLOWERS)}, {words}[list_position({words}, 'nonce') + 1]), false)"
    key = f"(list_contains({words}, 'key') AND NOT {has(KEY_DISQUALIFIERS)})"
    token = f"(list_contains({words}, 'token') AND NOT {has(TOKEN_DISQUALIFIERS)})"
    return f"""CASE WHEN len({words}) = 0 THEN NULL WHEN {has(DISQUALIFIERS)} OR (list_contains({words}, 'nonce') AND NOT {after}) OR {has(EXCLUSIONS)} THEN NULL
      WHEN list_contains({words}, 'mnemonic') THEN 'Mnemonic' WHEN {joined} = 'auth' THEN 'Sensitive'
      WHEN {phrase} OR {has(STRONG_KEYWORDS)} THEN 'Sensitive'
      WHEN {key} AND ({has(KEY_QUALIFIERS)} OR contains({joined}, 'logged_in')) THEN 'Key' WHEN {token} AND {has(TOKEN_QUALIFIERS)} THEN 'Token'
      WHEN {key} AND {words}[-1] = 'key' THEN 'Key' WHEN {token} AND {words}[-1] = 'token' THEN 'Token' END"""
