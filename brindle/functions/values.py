"""Functions over candidate values: shapes that rule a secret out, entropy, payment cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of placeholders.
PLACEHOLDERS = ("changeme", "change_me", "change-me", "dummy", "example", "expired", "fake", "fixme", "invalid", "masked", "mock", "obsolete", "placeholder", "redacted", "replace", "revoked", "sample", "test", "todo", "xxx", "your_")
# Card numbers that payment processors publish for tests.
TEST_CARDS = (
    "4000000000000002 4000000000000069 4000000000000101 4000000000000119 4000000000000127 4000000000000341 4000000000003220 4000000000005126 "
    "4000000000009979 4000000000009987 4000000000009995 4000002500003155 4000002760003184 4000008260003178 4000020000000000 4000033033003335 "
    "4000056655665556 4000060000000006 4000160000000004 4000180000000002 4000620000000007 4000640000000005 4000760000000001 4001020000000009 "
    "4001590000000001 4002690000000008 4003550000000003 4005519000000006 4012888888881881 4013250000000000006 4017340000000003 4111111111111111 "
    "4111111145551142 4111112014267661 4131840000000003 4151500000000008 4166676766766746 4199350000000002 4222222222222 4242424242424242 4293189100000008 "
    "4400000000000008 4400002000000004 4444333322221111 4484600000000004 4607000000000009 4646464646464644 4917610000000000 4977949494949497 "
    "4988080000000000 4988438843884305 2222400010000008 2222400030000004 2222400050000009 2222400060000007 2222400070000005 2222410700000002 "
    "2222410740360010 2223000048400011 2223000048410010 2223003122003222 2223520443560010 5002510000000013 5100060000000002 5103221911199245 "
    "5105105105105100 5127880999999990 5130290000000009 5200828282828210 5413330033003303 5454545454545454 5554444333311111 5555341244441115 "
    "5555555555554444 5577000055770004 6304000000000000 6703444444444449 6771798021000008 6771798021000016 371449635398431 3700000000000002 "
    "3700000001000018 3714496353984310 376680816376961 378282246310005 378734493671000 6011000990139424 6011111111111117 6011601160116611 6011609900000003 "
    "6011981111111113 6445644564456445 6445645000000002 3056930009020004 30569309025904 36227206271667 3600666633334400 3607050000001020 36461510000013 "
    "36461510000039 38520000023237 3530111333300000 3566002020360505 3569990010095841 6200000000000005 6200000000000047 6205500000000000004 "
    "6243030000000001 6555900000604105 4571000000000001 5019555544445555 4035501000000008 4035501428146300 4360000001000005 4871049999999910 "
    "4089670000000014 4687380100010006 5066991111111118 6062828888666688 "
).split()
#: Shapes as patterns over the trimmed, lower-cased value. They read alike in Java's dialect and RE2's.
SHAPES = {
    "file_path": r"^(?:/|\./|\.\./|~/|[a-z]:\\)",
    "integrity_hash": r"^sha(?:1|256|384|512)-",
    "version": r"^v?[0-9]+\.[0-9]",
    "aws_arn": r"^arn:aws(?:-cn|-us-gov)?:",
    "mime_type": r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+(?:;.*)?$",
    "css_variable": r"var\([ \t]*--[a-z0-9_-]",
    "template": r"^\$\{\{.*\}\}$",
    "variable_reference": r"\$\{|\{\{|#\{|^\$[a-z_]",
    "all_symbols": r"^[^0-9a-z]*$",
    "pure_hex": r"^[0-9a-f]{40,}$",
    "email": r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$",
    "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[t ][0-9]{2}:[0-9]{2}.*)?$",
    "markup": r"^<[a-z!/]|&[a-z]+;|&#[0-9]+;",
    "placeholder": "|".join(PLACEHOLDERS),
}


def normalized(value: Column) -> Column:
    """Trimmed of ASCII white space, ASCII letters in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.regexp_replace(value, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""), upper, upper.lower())


def shapes(value: Column) -> list[Column]:
    """A boolean column per shape."""
    return [value.rlike(pattern).alias(name) for name, pattern in SHAPES.items()]


def ruled_out(value: Column) -> Column:
    """Whether any shape but pure_hex speaks against a secret."""
    out = F.lit(False)
    for name, pattern in SHAPES.items():
        out = out | value.rlike(pattern) if name != "pure_hex" else out
    return out


def letters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def entropy(value: Column) -> Column:
    """Shannon entropy of a value's characters, in bits each."""
    chars = letters(value)
    n = F.size(chars)
    term = lambda c: (lambda p: -p * F.log2(p))(F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(n > 0, F.aggregate(F.transform(F.array_sort(F.array_distinct(chars)), term), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def alphabet_size(value: Column) -> Column:
    """26 for letters, 10 for digits, one for each other distinct character."""
    others = F.array_distinct(F.filter(letters(value), lambda c: ~c.rlike("[0-9a-z]")))
    return F.when(value.rlike("[a-z]"), 26).otherwise(0) + F.when(value.rlike("[0-9]"), 10).otherwise(0) + F.size(others)


def sufficient_entropy(value: Column) -> Column:
    """Eight characters and 40 bits at least; 3.5 bits a character or 85 % of what its alphabet allows; hex of 40 passes."""
    bits, n = entropy(value), F.char_length(value)
    dense = (bits >= 3.5) | (bits / F.log2(F.greatest(alphabet_size(value), F.lit(2))) >= 0.85)
    return value.rlike(SHAPES["pure_hex"]) | ((n >= 8) & (bits * n >= 40) & dense)


def is_card(value: Column) -> Column:
    """13 to 19 digits, the first from 2 to 6, with a right Luhn digit and no published test number; spaces and dashes are skipped."""
    digits = F.regexp_replace(value, "[ -]", "")
    return digits.rlike("^[2-6][0-9]{12,18}$") & F.call_function("luhn_check", digits) & ~digits.isin(*TEST_CARDS)


# Keys of connection strings that hold a credential.
CONNECTION_KEYS = ("accesskey", "accountkey", "awssecretaccesskey", "awssecretkey", "clientsecret", "password", "pwd", "secret", "secretaccesskey", "sharedaccesskey", "sharedaccesssignature")


def connection_credentials(value: Column) -> Column:
    """Values of the credential keys of a `k=v;k=v` connection string, which has two pairs at least. A value begins after its first `=`."""
    pairs = F.filter(F.split(value, ";"), lambda p: F.contains(p, F.lit("=")))
    parts = F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_replace(F.split_part(p, F.lit("="), F.lit(1)), "[^A-Za-z0-9]", "")).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(p, "^[^=]*=", "")), "^[\"']+|[\"']+$", "").alias("value")))
    found = F.transform(F.filter(parts, lambda p: p["key"].isin(*CONNECTION_KEYS) & (p["value"] != "")), lambda p: p["value"])
    return F.when(F.size(pairs) >= 2, found).otherwise(F.array().cast("array<string>"))


def authorization_credential(value: Column) -> Column:
    """The credential of an Authorization header: the password of Basic, the token of Bearer or of another scheme."""
    scheme, rest = F.lower(F.split_part(value, F.lit(" "), F.lit(1))), F.regexp_extract(value, r"^\S+\s+(.*)$", 1)
    decoded = F.try_to_binary(rest, F.lit("base64")).cast("string")
    return F.when(scheme == "basic", F.regexp_extract(decoded, r"^[^:]*:(.*)$", 1)).when(rest != "", rest)
