"""Small authored files, one for each extractor and detector, with what a scan of them finds.

Secrets are made here and belong to nobody. ``FILES`` has (group, path, text), ``FOUND`` the
findings as (path, rule, severity, name, assignment type, kind, line), and ``CANDIDATES`` what
the extractors alone give for some of them.
"""

from __future__ import annotations

import base64
import random

_r = random.Random(7)
A, B = ("".join(_r.choice("ABCDEFGHJKLMNPQRSTUVWXYZbcdfghjkmnpqrstvwxz23456789") for _ in range(28)) for _ in range(2))
CARD = "4532015112830366"
NPM = "npm" + "_" + "".join(_r.choice("abcXYZ019") for _ in range(36))
PEM = "-----BEGIN {0}PRIVATE KEY-----\n" + "A" * 64 + "\n-----END {0}PRIVATE KEY-----\n"
PUTTY = "PuTTY-User-Key-File-3: ssh-ed25519\nEncryption: none\nPrivate-Lines: 1\n" + "A" * 44 + "\nPrivate-MAC: 00ff\n"

FILES = (
    ("code", "a.js", f'const apiKey = "{A}";\nreq.setHeader("X-Api-Key", "{B}");\nfunction connect(user, password) {{}}\nconnect("bob", "{A}");'),
    ("code", "a.ts", f'class C {{ clientSecret: string = "{A}"; }}\nlogin("{B}");'),
    ("code", "a.py", f'password = "{A}"\nheaders = {{"Authorization": "Bearer {B}"}}\ntoken = "{A}"  # brindle:skip\n'),
    ("code", "a.go", f'package a\nconst apiKey = "{A}"\nfunc f() {{ req.Header.Set("X-Auth-Token", "{B}") }}\n'),
    ("code", "A.java", f'class A {{\n private static final String API_KEY = "{A}";\n void f() {{ conn.setRequestProperty("X-Api-Key", "{B}"); }}\n}}'),
    ("code", "a.kt", f'val apiKey = "{A}"\nval m = mapOf("password" to "{B}")\n'),
    ("code", "a.cs", f'class A {{ string password = "{A}"; void F() {{ Environment.SetEnvironmentVariable("API_TOKEN", "{B}"); }} }}'),
    ("code", "a.dart", f"const apiKey = '{A}';\n"),
    ("code", "a.swift", f'let apiKey = "{A}"\nrequest.setValue("Bearer {B}", forHTTPHeaderField: "Authorization")\n'),
    ("code", "a.groovy", f'def password = "{A}"\n'),
    ("code", "a.php", f'<html><?php $password = "{A}"; define("API_KEY", "{B}"); ?></html>'),
    ("code", "a.rb", f'API_KEY = "{A}"\nconfig = {{ password: "{B}" }}\n'),
    ("code", "a.rs", f'const API_KEY: &str = "{A}";\nfn main() {{ env::set_var("AUTH_TOKEN", "{B}"); }}\n'),
    ("code", "a.ps1", f'$password = "{A}"\n$env:API_TOKEN = "{B}"\n'),
    ("data", ".env", f"DB_PASSWORD={A}\nDB_URL=postgres://u:{B}@h/db\nCONN=Server=h;Password={A};\n"),
    ("data", "a.ini", f"[s]\napi_key = {A}\n"),
    ("data", ".netrc", f"machine a login b\n password {A}\n"),
    ("data", ".pgpass", f"h:1:d:u:{A}\n"),
    ("data", ".esmtprc", f'hostname = x\npassword = "{A}"\n'),
    ("data", ".git-credentials", f"https://u:{A}@github.com\n"),
    ("data", "redis.conf", f"requirepass {A}\n"),
    ("data", "a.sh", f'export API_TOKEN="{A}"\nPASSWORD=${{X:-{B}}} ./run\n'),
    ("data", "a.json", f'{{\n "db": {{"password": "{A}"}}, // c\n}}'),
    ("data", "a.yaml", f"env:\n  - name: DB_PASSWORD\n    value: {A}\n"),
    ("data", "a.toml", f'[auth]\nclient_secret = "{A}"\n'),
    ("data", "a.xml", f'<r><add key="Password" value="{A}"/></r>'),
    ("data", "a.plist", f'<?xml version="1.0"?><plist version="1.0"><dict><key>ApiKey</key><string>{A}</string></dict></plist>'),
    ("data", "Dockerfile", f"FROM x\nARG API_TOKEN={A}\nENV PASSWORD=${{API_TOKEN}}\nRUN SECRET={B} ./go\n"),
    ("data", "a.tf", f'terraform {{\n  backend "s3" {{\n    secret_key = "{A}"\n  }}\n}}\nvariable "db_password" {{\n  default = "{B}"\n}}\n'),
    ("data", "a.sql", f"CREATE USER bob IDENTIFIED BY '{A}';\nSET @api_token := '{B}';\n"),
    ("data", "a.ipynb", f'{{"cells": [{{"cell_type": "code", "source": ["password = \\"{A}\\""]}}], "metadata": {{}}}}'),
    ("markup", "a.html", f'<meta name="api-key" content="{A}"><script>\nlet clientSecret = "{B}";</script>'),
    ("markup", "a.vue", f'<template><p>{{{{ login("{A}") }}}}</p></template>\n<script>const apiKey = "{B}"</script>'),
    ("markup", "a.svelte", f'<script>const apiKey = "{A}"</script>\n<p>{{login("{B}")}}</p>'),
    ("markup", "a.astro", f'---\nconst apiKey = "{A}"\n---\n<p></p>'),
    ("markup", "a.blade.php", f'<p>\n@php $password = "{A}"; @endphp</p>'),
    ("markup", "a.ejs", f'<% const apiKey = "{A}" %>\n<b data-token="{B}">'),
    ("markup", "a.erb", f'<% api_key = "{A}" %>'),
    ("markup", "a.cshtml", f'@{{ var password = "{A}"; }}<p>x</p>'),
    ("markup", "a.twig", f'{{# "{B}" #}}{{% set apiKey = "{A}" %}}'),
    ("markup", "a.liquid", f'{{% assign api_key = "{A}" %}}{{% raw %}}{{% assign token = "{B}" %}}{{% endraw %}}'),
    ("schemas", "package.json", f'{{"scripts": {{"deploy": "API_TOKEN={A} ./x"}}}}'),
    ("schemas", "tasks.json", f'{{"tasks": [{{"command": "API_TOKEN={A} x"}}]}}'),
    ("schemas", "docker-compose.yml", f"services:\n  web:\n    command: API_KEY={A} ./go\n"),
    ("schemas", "mcp.json", f'{{"mcpServers": {{"a": {{"command": "API_KEY={A} x"}}}}}}'),
    ("schemas", ".github/workflows/a.yml", f"jobs:\n  b:\n    steps:\n      - run: PASSWORD={A} ./d.sh\n"),
    ("schemas", ".gitlab-ci.yml", f"b:\n  script:\n    - PASSWORD={A} ./d.sh\n"),
    ("schemas", ".circleci/config.yml", f"jobs:\n  b:\n    steps:\n      - run:\n          command: PASSWORD={A} x\n"),
    ("schemas", "azure-pipelines.yml", f"steps:\n  - bash: PASSWORD={A} x\n"),
    ("schemas", "buildspec.yml", f"phases:\n  build:\n    commands:\n      - PASSWORD={A} x\n"),
    ("schemas", "bitbucket-pipelines.yml", f"pipelines:\n  default:\n    - step:\n        script:\n          - PASSWORD={A} x\n"),
    ("schemas", ".buildkite/p.yml", f"steps:\n  - command: PASSWORD={A} x\n"),
    ("schemas", ".drone.yml", f"steps:\n  - name: b\n    commands:\n      - PASSWORD={A} x\n"),
    ("schemas", "secret.yaml", "apiVersion: v1\nkind: Secret\ndata:\n  anything: " + base64.b64encode(A.encode()).decode() + f"\nstringData:\n  other: {B}\n"),
    ("schemas", ".travis.yml", f"script: PASSWORD={A} x\n"),
    ("keys", "config/master.key", "0123456789abcdef0123456789abcdef\n"),
    ("keys", "id_rsa", PEM.format("RSA ")),
    ("keys", "id.ppk.txt", "# key\n" + PUTTY),
    ("keys", "notes.md", f"see\n{PEM.format('EC ')}and {NPM} there"),
    ("keys", "blob.md", f"AAAA+{NPM}+BBBB"),
    ("keys", "Card.java", f'class A {{ String cardNumber = "{CARD}"; String test = "4242424242424242"; }}'),
    ("keys", "run", f'#!/usr/bin/env bash\nexport API_TOKEN="{A}"\n'),
)

_W = "warning"
FOUND = (
    ("a.js", "secret-assignment", _W, "apiKey", "Constant", "Possible", 1), ("a.js", "secret-assignment", _W, "X-Api-Key", "Header", "Possible", 2), ("a.js", "secret-assignment", _W, "password", "Argument", "Possible", 4),
    ("a.ts", "secret-assignment", _W, "clientSecret", "Property", "Possible", 1), ("a.ts", "secret-assignment", _W, "password", "Argument", "Possible", 2),
    ("a.py", "secret-assignment", _W, "password", "Variable", "Possible", 1), ("a.py", "secret-assignment", _W, "Authorization", "Header", "Possible", 2),
    ("a.go", "secret-assignment", _W, "apiKey", "Constant", "Possible", 2), ("a.go", "secret-assignment", _W, "X-Auth-Token", "Header", "Possible", 3),
    ("A.java", "secret-assignment", _W, "API_KEY", "Constant", "Possible", 2), ("A.java", "secret-assignment", _W, "X-Api-Key", "Header", "Possible", 3),
    ("a.kt", "secret-assignment", _W, "apiKey", "Constant", "Possible", 1), ("a.kt", "secret-assignment", _W, "password", "Element", "Possible", 2),
    ("a.cs", "secret-assignment", _W, "password", "Variable", "Possible", 1), ("a.cs", "secret-assignment", _W, "API_TOKEN", "EnvironmentVariable", "Possible", 1),
    ("a.dart", "secret-assignment", _W, "apiKey", "Constant", "Possible", 1), ("a.swift", "secret-assignment", _W, "apiKey", "Constant", "Possible", 1), ("a.swift", "secret-assignment", _W, "Authorization", "Header", "Possible", 2),
    ("a.groovy", "secret-assignment", _W, "password", "Variable", "Possible", 1), ("a.php", "secret-assignment", _W, "password", "Variable", "Possible", 1), ("a.php", "secret-assignment", _W, "API_KEY", "Constant", "Possible", 1),
    ("a.rb", "secret-assignment", _W, "API_KEY", "Constant", "Possible", 1), ("a.rb", "secret-assignment", _W, "password", "Element", "Possible", 2),
    ("a.rs", "secret-assignment", _W, "API_KEY", "Constant", "Possible", 1), ("a.rs", "secret-assignment", _W, "AUTH_TOKEN", "Variable", "Possible", 2),
    ("a.ps1", "secret-assignment", _W, "password", "Variable", "Possible", 1), ("a.ps1", "secret-assignment", _W, "API_TOKEN", "EnvironmentVariable", "Possible", 2),
    (".env", "secret-assignment", _W, "DB_PASSWORD", "EnvironmentVariable", "Possible", 1), (".env", "secret-assignment", _W, "DB_URL", "EnvironmentVariable", "Url", 2), (".env", "secret-assignment", _W, "Password", "EnvironmentVariable", "Possible", 3),
    ("a.ini", "secret-assignment", _W, "api_key", "Property", "Possible", 2), (".netrc", "secret-assignment", _W, "password", "Property", "Possible", 2), (".pgpass", "secret-assignment", _W, "password", "Property", "Possible", 1),
    (".esmtprc", "secret-assignment", _W, "password", "Property", "Possible", 2), (".git-credentials", "secret-value", _W, None, None, "Url", 1), ("redis.conf", "secret-assignment", _W, "requirepass", "Directive", "Possible", 1),
    ("a.sh", "secret-assignment", _W, "API_TOKEN", "Variable", "Possible", 1), ("a.sh", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 2), ("a.json", "secret-assignment", _W, "db.password", "Element", "Possible", 2),
    ("a.yaml", "secret-assignment", _W, "env.DB_PASSWORD", "Element", "Possible", 3), ("a.toml", "secret-assignment", _W, "auth.client_secret", "Element", "Possible", 2), ("a.xml", "secret-assignment", _W, "Password", "Property", "Possible", 1),
    ("a.plist", "secret-assignment", _W, "ApiKey", "Element", "Possible", 1), ("Dockerfile", "secret-assignment", _W, "API_TOKEN", "BuildArgument", "Possible", 2), ("Dockerfile", "secret-assignment", _W, "PASSWORD", "EnvironmentVariable", "Possible", 3),
    ("Dockerfile", "secret-assignment", _W, "SECRET", "Variable", "Possible", 4), ("a.tf", "secret-assignment", _W, "secret_key", "BackendConfig", "Possible", 3), ("a.tf", "secret-assignment", _W, "db_password", "Variable", "Possible", 7),
    ("a.sql", "secret-assignment", _W, "password", "Property", "Possible", 1), ("a.sql", "secret-assignment", _W, "api_token", "Variable", "Possible", 2), ("a.ipynb", "secret-assignment", _W, "password", "Variable", "Possible", 1),
    ("a.html", "secret-assignment", _W, "api-key", "Attribute", "Possible", 1), ("a.html", "secret-assignment", _W, "clientSecret", "Variable", "Possible", 2), ("a.vue", "secret-assignment", _W, "password", "Argument", "Possible", 1),
    ("a.vue", "secret-assignment", _W, "apiKey", "Constant", "Possible", 2), ("a.svelte", "secret-assignment", _W, "apiKey", "Constant", "Possible", 1), ("a.svelte", "secret-assignment", _W, "password", "Argument", "Possible", 2),
    ("a.astro", "secret-assignment", _W, "apiKey", "Constant", "Possible", 2), ("a.blade.php", "secret-assignment", _W, "password", "Variable", "Possible", 2), ("a.ejs", "secret-assignment", _W, "apiKey", "Constant", "Possible", 1),
    ("a.ejs", "secret-assignment", _W, "data-token", "Attribute", "Possible", 2), ("a.erb", "secret-assignment", _W, "api_key", "Variable", "Possible", 1), ("a.cshtml", "secret-assignment", _W, "password", "Variable", "Possible", 1),
    ("a.twig", "secret-assignment", _W, "apiKey", "Variable", "Possible", 1), ("a.liquid", "secret-assignment", _W, "api_key", "Variable", "Possible", 1),
    ("package.json", "secret-assignment", _W, "API_TOKEN", "Variable", "Possible", 1), ("tasks.json", "secret-assignment", _W, "API_TOKEN", "Variable", "Possible", 1), ("docker-compose.yml", "secret-assignment", _W, "API_KEY", "Variable", "Possible", 3),
    ("mcp.json", "secret-assignment", _W, "API_KEY", "Variable", "Possible", 1), (".github/workflows/a.yml", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 4), (".gitlab-ci.yml", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 3),
    (".circleci/config.yml", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 5), ("azure-pipelines.yml", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 2), ("buildspec.yml", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 4),
    ("bitbucket-pipelines.yml", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 5), (".buildkite/p.yml", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 2), (".drone.yml", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 4),
    (".travis.yml", "secret-assignment", _W, "PASSWORD", "Variable", "Possible", 1), ("secret.yaml", "secret-assignment", _W, "anything", "Element", "Possible", 4), ("secret.yaml", "secret-assignment", _W, "other", "Element", "Possible", 6),
    ("config/master.key", "text-secret", "critical", None, None, "RailsKey", None), ("id_rsa", "text-secret", "critical", None, None, "PrivateKey", None), ("id.ppk.txt", "text-secret", "critical", None, None, "PuttyKey", None),
    ("notes.md", "secret-value", "critical", None, None, "PrivateKey", 2), ("notes.md", "secret-value", "critical", None, None, "Signature", 5), ("Card.java", "secret-assignment", "critical", "cardNumber", "Variable", "CreditCard", 1),
    ("run", "secret-assignment", _W, "API_TOKEN", "Variable", "Possible", 2),
)

#: (name, kind or none, weak, service or none)
NAMES = (
    ("dbPassword", "Sensitive", False, None), ("API_KEY", "Key", False, None), ("apikey", "Key", False, None), ("key", "Key", True, None), ("userToken", "Token", True, None), ("githubToken", "Token", False, None), ("securityAnswer", "Sensitive", True, None),
    ("test_password", None, None, None), ("nonce", None, None, None), ("nonceSecret", "Sensitive", False, None), ("monkey", None, None, None), ("passwordHash", None, None, None), ("auth", "Sensitive", False, None), ("pinCode", "Sensitive", False, None),
    ("walletMnemonic", "Mnemonic", False, None), ("cache_key", None, None, None), ("loggedInKey", "Key", True, None), ("datadogKey", "Key", False, "datadog"), ("fileName", None, None, None), ("accesstoken", "Token", False, None),
)
#: (value, the predicate, whether it holds)
VALUES = (
    ("the quick brown fox", "language_like", True), ("xkqzvjwq", "language_like", False), ("xxabcdefgh1", "alphabet_run", True), ("abcdxefgh", "alphabet_run", False), ("zqwertyui9", "keyboard_walk", True), ("qwerty", "keyboard_walk", False),
    ("87654321", "sequential", True), ("1234568", "sequential", False), ("#ffaa00", "is_color", True), ("rgb(1,2,3)", "is_color", True), ("#ggg", "is_color", False), ("0 12 * * 1-5", "is_cron", True), ("not a cron", "is_cron", False),
    ("en-us", "is_locale_or_zone", True), ("zh-hans-cn", "is_locale_or_zone", True), ("europe/berlin", "is_locale_or_zone", True), ("q9", "is_locale_or_zone", False), ("2024-01-02t03:04:05z[utc]", "is_datetime", True), ("2024", "is_datetime", False),
    ("${{ secrets.x }}", "is_template", True), ("${x}", "is_template", False), ("$home", "is_variable_reference", True), ("pa$s", "is_variable_reference", False), ("your_token", "is_placeholder", True), ("a1", "mixed_classes", True), ("ab", "mixed_classes", False),
    ("<!-- c -->", "is_markup", True), ("&#169;", "is_markup", True), ("a<b", "is_markup", False), ("v1.2", "is_version", True), ("a.b@c.org", "is_email", True), ("a@b", "is_email", False), (CARD, "is_card", True), ("4242424242424242", "is_card", False),
    (A.lower(), "sufficient_entropy", True), ("aaaaaaaaaaaa", "sufficient_entropy", False), ("hunter2", "weak_password", True), ("hunter", "weak_password", False), ("abcd", "password_literal", True), ("null", "password_literal", False),
    (A, "secret_shape", True), ("/etc/passwd", "secret_shape", False), ("sha256-abc", "secret_shape", False), ("passwört1", "secret_shape", False), ("********", "secret_shape", False), ("arn:aws:iam::1:x", "secret_shape", False),
)

#: (path, hex of the content, what it is)
BINARIES = (
    ("a.jks", "feedfeed0000000200000001", "JKS key store"), ("b.jceks", "cececece0000000100000002", "JCEKS key store"), ("c.kdb", "03d9a29a65fb4bb500000000", "KeePass KDB database"), ("d.kdbx", "03d9a29a67fb4bb500000400", "KeePass KDBX 4 database"),
    ("e.kdbx", "03d9a29a67fb4bb501000300", "KeePass KDBX 3 database"), ("f.p12", "3010020103300b06092a864886f70d010701", "PKCS#12 key store"), ("g.der", "3080020100300506032b65700409303132333435363738390000", None),
    ("h.der", "3013020100300506032b6570040730313233343536", "PKCS#8 Ed25519 private key"), ("i.der", "301b020100020101020101020101020101020101020101020101020101", "PKCS#1 RSA private key"),
    ("j.gpg", "94280460000000160000", "GPG/PGP EdDSA secret key"), ("k.gpg", "9c280460000000010000000000", "GPG/PGP RSA secret subkey"), ("l.gpg", "94280400000000160000", None), ("m.txt", "68656c6c6f", None),
)
#: (header, value, the credentials in it)
HEADERS = (
    ("Authorization", "Basic dXNlcjpodW50ZXIy", ("hunter2",)), ("Authorization", "Bearer abc", ("abc",)), ("Authorization", "Token xyz", ("xyz",)), ("Authorization", "plain", ("plain",)), ("Authorization", "Basic dXNlcjo=", ()),
    ("Cookie", "sid=abc; Path=/; HttpOnly", ("abc",)), ("Set-Cookie", "a=1; Max-Age=3; b=2", ("1", "2")), ("X-Api-Key", "k", ("k",)), ("Accept", "text/html", ()),
)
#: (connection string, the credentials in it)
CONNECTIONS = (
    ("Server=h;Password=a=b;", ("a=b",)), ("AccountName=x;AccountKey=Zm9v==;EndpointSuffix=y", ("Zm9v==",)), ("Password=only", ()), ("a=1;b=2", ()), ("Host=h;Client Secret='q';Pwd=w", ("q", "w")),
)
#: (URL, kind or none, location or none, keys)
URLS = (
    (f"postgres://u:{A}@h/db", "possible PostgreSQL URL secret", "userinfo", ""), (f"https://h/p?api_key={A}&x=1", "possible HTTP URL secret", "query", "api_key"), (f"https://h/p#access_token={A}", "possible HTTP URL secret", "fragment", "access_token"),
    ("https://h/p?x=1", None, None, ""), ("https://u:changeme@h/", None, None, ""), (f"weird://u:{A}@h", "possible service URL secret", "userinfo", ""), ("mailto:a@b.org", None, None, ""), (f"amqps://u:{A}@h:5671", "possible RabbitMQ URL secret", "userinfo", ""),
)
#: (path, text) of a tree with rc and ignore files, and (path, why it is skipped).
TREE = (
    (".brindlerc.toml", 'skip-directory-names = ["private"]\nskip-glob = ["docs/**/*.md"]'), ("sub/.brindlerc.toml", 'skip-file-names = ["a.py"]\nauto-excludes = false'), (".gitignore", "*.log\n!keep.log\nbuild/\n/only.txt"), ("sub/.gitignore", "!x.log"),
    ("a.py", "x"), ("sub/a.py", "x"), ("private/b.py", "x"), ("docs/x/c.md", "x"), ("node_modules/d.js", "x"), ("sub/node_modules/d.js", "x"), ("z.log", "x"), ("keep.log", "x"), ("sub/x.log", "x"), ("build/e.py", "x"), ("only.txt", "x"), ("sub/only.txt", "x"), (".DS_Store", "x"),
)
REASONS = (
    (".brindlerc.toml", None), ("sub/.brindlerc.toml", None), (".gitignore", None), ("sub/.gitignore", None), ("a.py", None), ("sub/a.py", "file name"), ("private/b.py", "directory name"), ("docs/x/c.md", "glob"), ("node_modules/d.js", "excluded directory"),
    ("sub/node_modules/d.js", None), ("z.log", "ignored by version control"), ("keep.log", None), ("sub/x.log", None), ("build/e.py", "ignored by version control"), ("only.txt", "ignored by version control"), ("sub/only.txt", None), (".DS_Store", "system metadata"),
)
#: (text, the moment that it cuts off at, as seconds)
CUTOFFS = (("2024-01-02", 1704239999), ("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02T03:04:05+02:00", 1704157445), ("Tue Jan 2 03:04:05 2024 +0000", 1704164645), ("soon", None))
#: Calls and definitions: (path, callee, seq, arguments) and (path, name, seq, parameters).
CALLS = (("a", "f", 3, ("x", "y")), ("a", "g", 4, ("z",)), ("b", "f", 1, ("w",)))
DEFINITIONS = (("a", "f", 1, ("p", "q")), ("a", "f", 2, ("r", "s", "t")), ("b", "h", 1, ("u",)))
#: Findings of one file: (path, finding, severity, from_content_scan, start, end), and which stay.
SPANS = (("p", 1, "warning", True, 0, 10), ("p", 2, "warning", False, 5, 8), ("p", 3, "critical", False, 4, 9), ("p", 4, "warning", True, 20, 30), ("p", 5, "critical", True, 18, 32), ("p", 6, "warning", False, 40, 50), ("p", 7, "critical", False, 40, 50), ("q", 8, "warning", True, 0, 10))
KEPT = (3, 5, 6, 7, 8)
#: (article for, article), and (object, name, access)
ARTICLES = (("AWS key", "an"), ("possible secret", "a"), ("API token", "an"), ("URL secret", "a"), ("unit", "a"), ("Adyen key", "an"), ("SSH key", "an"))
ACCESSES = (("a", "b", "a.b"), ("a", "b c", 'a["b c"]'), ("a", "1x", 'a["1x"]'), ("a", 'q"r', 'a["q\\"r"]'), ("a", "$_", "a.$_"))
#: (path, why the column rules skip it), with the names `secret.txt`, the glob `docs/**/*.md` and lock files left out.
PATHS = (("node_modules/x.js", "directory"), ("a/secret.txt", "name"), ("docs/x/y.md", "glob"), ("docs/y.md", "glob"), (".DS_Store", "metadata"), ("yarn.lock", "lock file"), ("src/a.py", None), ("a/node_modules", None))
#: (glob, path, whether it matches)
GLOBS = (("*.py", "a.py", True), ("*.py", "x/a.py", False), ("**/*.py", "x/y/a.py", True), ("**/*.py", "a.py", True), ("a?.{js,ts}", "ab.ts", True), ("a?.{js,ts}", "abc.ts", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("x/**", "x/y/z", True))
#: A dictionary, and (value, the test, whether it holds) under it.
WORDS = ("purple", "monkey", "dishwasher", "administrator", "green")
VERDICTS = (
    ("purpleMonkeyDishwasher", "known_words", True), ("purpleXk", "known_words", False), ("purple9monkeyZq", "known_words", True), ("purplemonkey", "known_words", True), ("zqxwvkjh", "known_words", False), ("administratorx", "run_together", True),
    ("administrator1", "run_together", False), ("purple_monkey-zz", "identifier", True), ("purplemonkey", "identifier", False), ("xadministratorx", "long_word", True), ("administrator" + "x" * 40, "long_word", False),
)
#: (script, its commands)
COMMANDS = (("A=1 curl -H 'x y' | grep z", "curl|-H|x y;grep|z"), ("if true; then echo \"a b\" # c\nfi", "if|true;then|echo|a b;fi"), ("", ""))
#: (tree as JSON, path with * for any step, the values there)
TREES = (('{"a": [{"b": 1}, {"b": 2}, {"c": 3}]}', "a.*.b", "1,2"), ('{"a": {"x": "1", "y": "2"}}', "a.*", "1,2"), ('{"a": 1}', "b", ""))
#: Changed paths, and (path, whether it is scanned again).
CHANGED = ("x/.gitignore", "z/d.py")
AGAIN = (("a.py", False), ("x/b.py", True), ("x/y/c.py", True), ("z/d.py", True), ("z/e.py", False))
