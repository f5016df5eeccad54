from brindle.operators import extract


def run(spark, operator, text, *args):
    df = spark.createDataFrame([("p", text), ("empty", ""), ("null", None)], "path string, text string")
    return [(r.name, r.value) for r in operator(df, *args).collect()]


def test_config(spark):
    text = "# a = b\n[part]\nexport KEY=\"one # two\"\nname: three ; note\nlong = x\\\n  y\nempty =\r\nquote = 'q'\r\n! no = no"
    assert run(spark, extract.config, text) == [("KEY", "one # two"), ("name", "three"), ("long", "xy"), ("quote", "q")]


def test_line_formats(spark):
    assert run(spark, extract.netrc, "machine a login b\n password c machine d password e") == [("password", "c"), ("password", "e")]
    assert run(spark, extract.pgpass, "#h:1:d:u:no\nh:1:d:u:a\\:b\\\\c\n*:*:*:u:second\nh:1") == [("password", "a:b\\c"), ("password", "second")]
    assert run(spark, extract.credential_urls, "https://me:p%40ss@host/x\nhttps://host/me:no@x") == [("me", "p@ss")]
    assert run(spark, extract.mail_passwords, 'username = a\n PassWord = "b c"\npwd d') == [("password", "b c"), ("pwd", "d")]
    text = 'port 1\nrequirepass "one"\n# masterauth no\nuser ann on >two <three ~* #four +get'
    assert run(spark, extract.redis, text) == [("requirepass", "one"), ("ann", "two"), ("ann", "three"), ("ann", "four")]


def test_trees(spark):
    assert run(spark, extract.tree, '{"a": {"b": ["x", 1, "y"]}, "c": "z"}', "json") == [("a.b", "x"), ("a.b", "y"), ("c", "z")]
    assert run(spark, extract.tree, '[a]\nb = "x"\n[[a.c]]\nd = "y"', "toml") == [("a.b", "x"), ("a.c.d", "y")]
    assert run(spark, extract.tree, "{broken", "json") == [] and run(spark, extract.tree, "[" * 100_000, "json") == []
