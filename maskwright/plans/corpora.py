"""Corpora derived from the given tables by text expressions.

The expressions are plain SQL that Spark and DuckDB read alike (no backslash,
no engine-specific function), so a check can build the same texts on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows that a task turns into texts and scans, and rows where a task has the texts of whole documents.
TASK_ROWS = 16_384
TEXT_ROWS = 131_072
WHOLE_TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = TEXT_ROWS if name in WHOLE_TEXTS else TASK_ROWS
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), rows)


def spread(scan: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Deal out the rows of a plain file scan that has fewer tasks than cores, or a task of more than ``rows`` rows.

    Scanning texts is bound by the CPU, and many a text is made of a short row, so tasks are measured by rows.
    A row group is read by one task however many splits its file has, so the number of tasks alone does not show
    that they share the rows.  They are counted from the footers of the files; no column is read for that.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    shares = scan.groupBy(F.spark_partition_id()).count()
    largest, total = shares.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    uneven = scan.rdd.getNumPartitions() < cores or largest > rows
    return scan.repartition(max(4 * cores, -(-total // rows))) if uneven else scan


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(names: str, number: str) -> str:
    size = names.count(",") + 1
    return f"split_part('{names}', ',', CAST(({number}) % {size} + 1 AS INT))"


def digits(number: str, width: int) -> str:
    """``width`` digits of a number, wrapped so that nothing is cut silently."""
    return f"lpad(CAST(({number}) % {10 ** width} AS VARCHAR(20)), {width}, '0')"


FIRST = "Ana,Ben,Carla,David,Elena,Farid,Grace,Hugo,Irene,James,Karim,Laura,Marco,Nadia,Omar,Paula"
LAST = "Adams,Brown,Costa,Dubois,Evans,Fischer,Garcia,Hassan,Ivanov,Jensen,Keller,Lopez,Moreau"
MONTH = "January,February,March,April,May,June,July,August,September,October,November,December"


def _people_text(k: str = "c_custkey", country: str = "n_name") -> str:
    first, last = pick(FIRST, k), pick(LAST, f"{k} * 7 + 3")
    boss = f"{pick(FIRST, f'{k} + 5')} || ' ' || {pick(LAST, f'{k} + 4')}"
    mail = (
        f"lower({first}) || CASE WHEN {k} % 5 = 0 THEN '_' ELSE '.' END || lower({last}) || "
        f"CAST({k} AS VARCHAR(20)) || '@mail' || CAST({k} % 7 AS VARCHAR(20)) || '.example.com'"
    )
    d, m, y = digits(f"{k} % 28 + 1", 2), digits(f"{k} % 12 + 1", 2), digits(f"{k} % 50", 2)
    iban = (
        f"CASE WHEN {k} % 2 = 0 THEN 'AE07 0331 ' || {digits(f'{k} * 31', 4)} || ' 6789 0123 456' "
        f"ELSE 'AE070331' || {digits(f'{k} * 31', 4)} || '67890123456' END"
    )
    card = (
        f"CASE {k} % 4 WHEN 0 THEN '4111' || {digits(f'{k} * 77', 12)} "
        f"WHEN 1 THEN '5200-' || {digits(f'{k} * 3', 4)} || '-1111-' || {digits(f'{k} * 17', 4)} "
        f"WHEN 2 THEN '3714' || {digits(f'{k} * 91', 11)} "
        f"ELSE '6011' || {digits(f'{k} * 13', 12)} END"
    )
    separator = "━━━━━━━━━━"
    lines = [
        "'PERSONAL INFORMATION'",
        f"'{separator}'",
        f"'Full Name: ' || {first} || ' ' || {last}",
        f"'Email: ' || {mail}",
        f"'Date of Birth: ' || {d} || '/' || {m} || '/19' || {y}",
        f"'Joined ' || CAST({k} % 28 + 1 AS VARCHAR(20)) || ' ' || {pick(MONTH, k)} || ' 20' || {y}",
        f"'Valid until 20' || {y} || '-' || {m} || '-' || {d} || ' only'",
        f"'Emirates ID: 784-19' || {y} || '-' || {digits(f'{k} * 19', 7)} || '-' || {digits(k, 1)}",
        f"'SSN: ' || {digits(f'{k} + 100', 3)} || '-' || {m} || '-' || {digits(f'{k} * 7', 4)}",
        f"'IBAN: ' || {iban}",
        f"'Passport No: A' || {digits(f'{k} * 37', 8)}",
        f"'Travel paper QX' || {digits(f'{k} * 41', 7)} || ' seen'",
        f"'Old number ' || {digits(f'{k} * 43 + 100000000', 9)}",
        f"'Card: ' || {card}",
        f"'Mobile: +971 50 ' || {digits(f'{k} * 3', 3)} || ' ' || {digits(f'{k} * 11', 4)}",
        f"'Office 04' || {digits(k, 1)} || ' ' || {digits(f'{k} * 5', 3)} || ' ' || {digits(f'{k} * 9', 4)}",
        f"'Host 10.' || CAST({k} % 256 AS VARCHAR(20)) || '.' || CAST({k} * 7 % 256 AS VARCHAR(20)) || '.9'",
        f"'Long 2001:0db8:0000:0000:0000:ff00:0042:' || {digits(k, 4)} || ' end'",
        f"'See https://example.org/u/' || CAST({k} AS VARCHAR(20)) || CASE {k} % 3 WHEN 0 THEN '?id=7' WHEN 1 THEN '|next' ELSE '' END || ' now'",
        f"'Go www.site' || CAST({k} % 90 AS VARCHAR(20)) || '.com/p'",
        f"'Country: ' || replace({country}, '_', ' ')",
        f"'National: ZK' || {digits(f'{k} * 3', 6)}",
        f"'Civil: Z' || {digits(f'{k} * 23', 7)} || 'P'",
        f"'Staff EMP' || CAST({k} AS VARCHAR(20)) || ' REF' || {digits(k, 3)}",
        f"'Medical certificate AB' || {digits(f'{k} * 29', 7)}",
        f"'Bank account: ' || {digits(f'{k} * 53', 11)}",
        f"'Driver license: D' || {digits(f'{k} * 59', 7)}",
        f"'Plate AB' || {digits(k, 2)} || ' XYZ and VIN JTMRV33V8765' || {digits(k, 5)}",
        f"'Manager: ' || {boss} || ' | 055 ' || {digits(f'{k} * 2', 3)} || ' ' || {digits(k, 4)} || ' | done'",
        f"'Account Name: ' || {boss}",
        f"'one two three four passport five six seven eight nine ' || {digits(f'{k} * 61 + 200000000', 9)}",
        f"'one two three four five passport six seven eight nine ' || {digits(f'{k} * 67 + 300000000', 9)}",
        f"'Again: ' || {mail} || ' and ' || {mail}",
    ]
    body = " || chr(10) || ".join(lines)
    return f"CASE WHEN {k} % 97 = 0 THEN '  ' ELSE {body} END"


PEOPLE_TEXT = _people_text()
PEOPLE_SQL = (
    f"SELECT c_custkey AS doc_id, c_mktsegment AS segment, {PEOPLE_TEXT} AS text "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey"
)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled record of personal data per customer; every 97th is blank."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.selectExpr("c_custkey AS doc_id", "c_mktsegment AS segment", f"{PEOPLE_TEXT} AS text")


# Snippets: @H is a hash of the key, @U its first 16 characters in capitals, @N a
# small number.  The first 25 hold one credential each, the next 20 one weakness.
SECRET_SNIPPETS = (
    'key = "AKIA@U"',
    'PEM = """-----BEGIN RSA PRIVATE KEY-----\nMII@H\n-----END RSA PRIVATE KEY-----"""',
    'PEM = """-----BEGIN EC PRIVATE KEY-----\nMHc@H\n-----END EC PRIVATE KEY-----"""',
    'PEM = """-----BEGIN CERTIFICATE-----\nMIID@H\n-----END CERTIFICATE-----"""',
    'azure_client_secret = "@H"',
    'gh = "ghp_@H"',
    'gl = "glpat-@H"',
    'sl = "xoxb-@H"',
    'st = "sk_live_@H"',
    'oa = "sk-proj-@H"',
    'an = "sk-ant-@H"',
    'sg = "SG.@H.@H"',
    'tw = "SK@H"',
    'mc = "@H-us12"',
    'mb = "pk.eyJ@H.@H"',
    'jw = "eyJ@H.@H.@H"',
    'head = "Authorization: Bearer @H"',
    'refresh_token = "@H"',
    "db_password = 'pw-@H'",
    'app_secret_key: "@H"',
    'dsn = "postgres://app:@H@db.internal:5432/app"',
    'pub = "ssh-rsa AAAA@H box"',
    'hook = "https://hooks.slack.com/services/T00/B00/@H"',
    'hook = "https://discord.com/api/webhooks/12@N/@H"',
    'server_host = "10.0.@N.7"',
)
CODE_SNIPPETS = (
    'cursor.execute("SELECT a FROM t WHERE id = \'@N\'" % x)',
    'os.system(f"rm @N")',
    "ldap.search(base, filter + '@N')",
    "xpath = '//a[' + input",
    'h = hashlib.md5(b)',
    'salt = "salt@N"',
    'import random',
    'obj = pickle.loads(b)',
    'cfg = yaml.load(f)',
    'eval(expr@N)',
    'get(u, verify=False)',
    "u = 'http://example@N.org/x'",
    "bind = '0.0.0.0'",
    'jwt_secret = "abc@N"',
    'session_secret = "s3ss@N"',
    'open(request.path)',
    'p = tempfile.mktemp()',
    'app.run(debug=True)',
    'print(password)',
    'requests',
)
SNIPPETS = SECRET_SNIPPETS + CODE_SNIPPETS


def _code_text(k: str = "o_orderkey") -> str:
    def snippet(number: str) -> str:
        cases = " ".join(f"WHEN {i} THEN {literal(s)}" for i, s in enumerate(SNIPPETS))
        return f"CASE {number} {cases} END"

    size = len(SNIPPETS)
    hashed = f"md5(CAST({k} AS VARCHAR(20)))"
    second = f"CAST(floor({k} / {size}) AS BIGINT) % {size}"
    template = (
        f"'# module ' || CAST({k} AS VARCHAR(20)) || chr(10) || 'def f(x):' || chr(10) || '    ' || "
        f"({snippet(f'{k} % {size}')}) || chr(10) || '    y = x + 1' || chr(10) || "
        f"({snippet(second)}) || chr(10) || '    return y  # fine' || chr(10)"
    )
    return (
        f"replace(replace(replace({template}, '@H', {hashed}), '@U', upper(substr({hashed}, 1, 16))), "
        f"'@N', CAST({k} % 200 AS VARCHAR(20)))"
    )


CODE_TEXT = _code_text()
CODE_EXT = "CASE o_orderkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'js' ELSE 'conf' END"
CODE_SQL = f"SELECT o_orderkey AS doc_id, {CODE_EXT} AS ext, {CODE_TEXT} AS text FROM orders"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per order with two snippets, so that greedy rules span lines."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS doc_id", f"{CODE_EXT} AS ext", f"{CODE_TEXT} AS text"
    )


# Each conversation mentions a few mail addresses and phones, some of them again.
CHAT_TEXT = (
    "text || chr(10) || 'Write to user' || CAST(conv_id * 3 + turn % 3 AS VARCHAR(20)) || "
    "'@chat.example.com or call +44 20 ' || " + digits("conv_id * 17 + turn % 4", 4) + " || ' ' || "
    + digits("conv_id + turn", 4) + " || ' today, ' || 'not user' || "
    "CAST(conv_id * 3 + (turn + 1) % 3 AS VARCHAR(20)) || '@chat.example.com' || '.'"
)
CHAT_SQL = (
    "SELECT conv_id * 100 + turn AS doc_id, conv_id, turn, " + CHAT_TEXT + " AS text FROM conversations"
)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with contact data spliced in; session is the conversation."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 100 + turn AS doc_id", "conv_id", "turn", f"{CHAT_TEXT} AS text"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Files of every format, made from the customer table.
_NAME = "c_name"
_SEG = "c_mktsegment"
_KEY = "CAST(c_custkey AS VARCHAR(20))"
FILE_EXT = pick("txt,md,csv,html,json,xml,eml,log", "c_custkey")
FILE_RAW = (
    "CASE c_custkey % 8 "
    f"WHEN 2 THEN 'id, name ,seg' || chr(13) || chr(10) || {_KEY} || ',\"' || {_NAME} || ', Inc\",' || chr(10) || ' , ,' || {_SEG} || chr(10) "
    f"WHEN 3 THEN '<html><body><h1>' || {_NAME} || '</h1>  <p>' || {_SEG} || '</p></body></html>' "
    f"WHEN 4 THEN '{{\"z\": ' || {_KEY} || ',\"name\":\"' || {_NAME} || '\", \"tags\" : [\"' || {_SEG} || '\", null], \"e\": []}}' "
    f"WHEN 5 THEN '<?xml version=\"1.0\"?><c id=\"' || {_KEY} || '\"><!-- n --><name> ' || {_NAME} || ' </name>tail<seg a=\"1\" b=\"x &amp; y\"/></c>' "
    f"WHEN 6 THEN 'Date: today' || chr(10) || 'X-Skip: 1' || chr(10) || 'From: a' || {_KEY} || '@example.com' || chr(10) || 'Subject: ' || {_NAME} || chr(10) || ' again' || chr(10) || chr(10) || 'Body ' || {_SEG} || chr(10) "
    f"ELSE 'Plain ' || {_NAME} || chr(13) || chr(10) || {_SEG} || chr(10) END"
)
FILE_TEXT = (
    "CASE c_custkey % 8 "
    f"WHEN 2 THEN 'id | name | seg' || chr(10) || {_KEY} || ' | ' || {_NAME} || ', Inc' || chr(10) || {_SEG} "
    f"WHEN 3 THEN {_NAME} || chr(10) || {_SEG} "
    f"WHEN 4 THEN '{{' || chr(10) || '  \"z\": ' || {_KEY} || ',' || chr(10) || '  \"name\": \"' || {_NAME} || '\",' || chr(10) || '  \"tags\": [' || chr(10) || '    \"' || {_SEG} || '\",' || chr(10) || '    null' || chr(10) || '  ],' || chr(10) || '  \"e\": []' || chr(10) || '}}' "
    f"WHEN 5 THEN '<c id=\"' || {_KEY} || '\">' || chr(10) || '  <name> ' || {_NAME} || chr(10) || '  <seg a=\"1\" b=\"x & y\">' "
    f"WHEN 6 THEN 'From: a' || {_KEY} || '@example.com' || chr(10) || 'Subject: ' || {_NAME} || ' again' || chr(10) || 'Date: today' || chr(10) || chr(10) || 'Body ' || {_SEG} || chr(10) "
    f"ELSE 'Plain ' || {_NAME} || chr(10) || {_SEG} || chr(10) END"
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw file texts of eight kinds: (doc_id, ext, raw)."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS doc_id", f"{FILE_EXT} AS ext", f"{FILE_RAW} AS raw"
    )


# Reports of an outside scanner: one JSON report per part, one or two results.
REPORT_JSON = (
    "'{\"results\":[{\"test_id\":\"B' || " + digits("p_partkey", 3) + " || '\",\"test_name\":\"weak_' || "
    "split_part(p_name, ' ', 1) || '_md5-use_of2hash\",\"issue_text\":\"Found in ' || p_name || '\",\"issue_severity\":\"' || "
    + pick("LOW,MEDIUM,HIGH,UNDEFINED", "p_partkey") + " || '\",\"line_number\":' || "
    "CAST(p_size AS VARCHAR(20)) || ',\"code\":\"' || chr(92) || 'n 3 x = 1' || chr(92) || 'n4 y' || chr(92) || 'n\",\"issue_cwe\":{\"id\":' || "
    "CAST(p_partkey % 900 AS VARCHAR(20)) || '}},{\"test_name\":\"weak_hash\",\"line_number\":3}]}'"
)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", f"{REPORT_JSON} AS report")
