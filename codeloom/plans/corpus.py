"""Sources with known findings: one snippet a rule, its expected findings written by hand, repeated over the part table.

Part k has snippet k modulo their number after k modulo 3 blank lines, so lines differ; SQL adds the same shift to the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread

#: Source and its findings (line, rule id, severity), all of them.
SNIPPETS: tuple[tuple[str, tuple[tuple[int, str, str], ...]], ...] = (
    ("eval(x)", ((1, "D001", "HIGH"),)),
    ("exec(x)", ((1, "D002", "HIGH"),)),
    ("os.system(cmd)\nos.system('ls')", ((1, "D003", "CRITICAL"),)),
    ("subprocess.run(c, shell=True)\nsubprocess.run('ls', shell=True)", ((1, "D003", "CRITICAL"),)),
    ("asyncio.create_subprocess_shell(c)\nos.popen(c)\npty.spawn('sh')", ((1, "D004", "CRITICAL"), (2, "D004", "HIGH"))),
    ("x = input()", ((1, "D005", "HIGH"),)),
    ("os.setuid(0)\nos.setgroups([])", ((1, "D006", "HIGH"), (2, "D006", "HIGH"))),
    ("cur.execute(q)\ncur.execute('select 1')\ncur.executemany(f'{q}')", ((1, "D101", "CRITICAL"), (3, "D101", "CRITICAL"))),
    ("Model.objects.raw(q)\npd.read_sql(q)\nTemplate(t).substitute(x)", ((1, "D102", "CRITICAL"), (2, "D102", "CRITICAL"), (3, "D102", "CRITICAL"))),
    ("Markup(x)\nHTMLResponse(content=x)\nMarkup('a')", ((1, "D103", "HIGH"), (2, "D103", "HIGH"))),
    ("xml.dom.minidom.parse(f)\nlxml.etree.parse(f)\nlxml.etree.parse(f, resolve_entities=False)", ((1, "D104", "MEDIUM"), (2, "D104", "HIGH"))),
    ("mark_safe(x)", ((1, "D105", "MEDIUM"),)),
    ("import ldap\nc = ldap.initialize('u')\nc.search_s('b', 2, q)\nc.search_s('b', 2, '(a=b)')\nc.search('b', 2, filterstr=q)", ((3, "D106", "HIGH"), (5, "D106", "HIGH"))),
    ("from ldap3 import Connection as K\nc = K('s')\nc.search('b', q)\nother.search('b', q)", ((3, "D106", "HIGH"),)),
    ("tree.xpath(q)\ntree.xpath('//a')", ((1, "D107", "HIGH"),)),
    ("pickle.loads(d)\nshelve.open('x')", ((1, "D201", "CRITICAL"), (2, "D201", "CRITICAL"))),
    ("yaml.load(f)\nyaml.load(f, Loader=yaml.SafeLoader)", ((1, "D202", "HIGH"),)),
    ("marshal.loads(b)", ((1, "D203", "MEDIUM"),)),
    ("torch.load(p)\ntorch.load(p, weights_only=True)\njoblib.load(p)", ((1, "D204", "CRITICAL"), (3, "D204", "HIGH"))),
    ("hashlib.md5(b)\nhashlib.new('md4')", ((1, "D301", "MEDIUM"), (2, "D301", "MEDIUM"))),
    ("hashlib.sha1(b)\nhashlib.sha256(b)", ((1, "D302", "MEDIUM"),)),
    ("Blowfish.new(k)", ((1, "D304", "HIGH"),)),
    ("modes.ECB()", ((1, "D305", "MEDIUM"),)),
    ("nacl.bindings.crypto_box(k)\nimport nacl.bindings", ((1, "D306", "HIGH"), (2, "D306", "HIGH"))),
    ("random.random()\nsecrets.token_hex()", ((1, "D311", "LOW"),)),
    ("requests.get('http://x', verify=False, timeout=3)", ((1, "D401", "HIGH"),)),
    ("requests.get(u, timeout=3)\nrequests.request('GET', u, timeout=3)", ((1, "D402", "CRITICAL"), (2, "D402", "CRITICAL"))),
    ("app.run(debug=True)\napp.run(debug=False)", ((1, "D403", "HIGH"),)),
    ("host = '0.0.0.0'\nserve(host='::')\ns.bind(('0.0.0.0', 80))\ns.bind(('127.0.0.1', 80))", ((1, "D404", "MEDIUM"), (2, "D404", "MEDIUM"), (3, "D404", "MEDIUM"))),
    ("requests.get('http://x')\nhttpx.post('http://x', timeout=None)\nrequests.get('http://x', timeout=1)", ((1, "D405", "MEDIUM"), (2, "D405", "MEDIUM"))),
    ("ftplib.FTP('h')", ((1, "D406", "HIGH"),)),
    ("http.client.HTTPSConnection('h')\nhttp.client.HTTPSConnection('h', context=c)", ((1, "D407", "MEDIUM"),)),
    ("ssl._create_unverified_context()", ((1, "D408", "MEDIUM"),)),
    ("telnetlib.Telnet('h')", ((1, "D409", "HIGH"),)),
    ("urllib.request.urlretrieve('http://x')", ((1, "D410", "MEDIUM"),)),
    ("ssl.wrap_socket(s)", ((1, "D411", "MEDIUM"),)),
    ("StdioServerParameters(command=c)\nStdioServerParameters(command='ls')", ((1, "D412", "CRITICAL"),)),
    ("open(p)\nopen('a')\nos.path.join('a', 'b')", ((1, "D501", "HIGH"),)),
    ("tar.extractall()\nx.extractall()\ntar.extractall(filter='data')", ((1, "D502", "HIGH"), (2, "D502", "MEDIUM"))),
    ("zip_file.extractall()", ((1, "D503", "HIGH"),)),
    ("tempfile.mktemp()", ((1, "D504", "HIGH"),)),
    ("os.chmod('f', 0o777)\nos.chmod('f', stat.S_IWOTH)\nos.chmod('f', 0o600)", ((1, "D505", "HIGH"), (2, "D505", "HIGH"))),
    ("os.tempnam()", ((1, "D506", "MEDIUM"),)),
    ("if os.path.exists('a'):\n    open('a')\nif os.path.exists('a'):\n    open('b')", ((1, "D507", "MEDIUM"),)),
    ("p = Path('a')\nif not p.exists():\n    pass\nelse:\n    p.open()", ((2, "D507", "MEDIUM"),)),
    ("t = 'a'\nt.append(1)\nt.upper()\nn = [1]\nn.push(2)", ((2, "D601", "HIGH"), (5, "D601", "HIGH"))),
    ("assert x", ((1, "D701", "LOW"),)),
    ("import telnetlib\nimport pickle\nimport json", ((1, "D702", "HIGH"), (2, "D702", "LOW"))),
    ("Environment(autoescape=False)", ((1, "D703", "HIGH"),)),
    ("y = password == 'admin'\nz = 'root' != user.login\nw = colour == 'admin'", ((1, "D705", "HIGH"), (2, "D705", "HIGH"))),
    ("logging.info('x', password)\nlogging.info('y', size)", ((1, "D901", "MEDIUM"),)),
    ("SECRET_KEY = 'abc'", ((1, "D902", "CRITICAL"),)),
    ("@csrf_exempt\ndef view(r):\n    return r", ((1, "D903", "HIGH"),)),
    ("logger.info(f'x {y}')\nlogger.info('x')", ((1, "D904", "MEDIUM"),)),
    ("def f(a=[], b={}, c=set()):\n    return a", ((1, "L001", "MEDIUM"), (1, "L001", "MEDIUM"), (1, "L001", "MEDIUM"))),
    ("try:\n    f()\nexcept:\n    pass", ((3, "L002", "LOW"),)),
    ("y = x == None\nz = x is None", ((1, "L003", "LOW"),)),
    ("def f(x):\n" + "    if x: pass\n" * 11, ((1, "Q301", "MEDIUM"),)),
    ("def f(x):\n" + "    if x: pass\n" * 16, ((1, "Q301", "HIGH"), (1, "Q304", "HIGH"))),
    ("def f(x):\n    if x:\n        if x:\n            if x:\n                if x:\n                    pass", ((5, "Q302", "LOW"),)),
    ("def f(x):\n" + "    if x:\n        if x:\n            if x:\n                pass\n" * 3, ((1, "Q304", "HIGH"),)),
    ("class A:\n" + "".join(f"    def m{k}(self):\n        return self.f{k}\n" for k in range(7)), ((1, "Q305", "HIGH"),)),
    ("class A(BaseModel):\n" + "".join(f"    def m{k}(self):\n        return self.f{k}\n" for k in range(7)), ()),
    ("def f(a, b, c, d, e, *g):\n    return a", ((1, "C303", "LOW"),)),
    ("def f():\n" + "    x = 1\n" * 51, ((1, "C304", "LOW"),)),
    ("y = x in [1, 2, 3, 4]\nz = x in [1, 2]\nfor i in q:\n    w = i in [1]", ((1, "P001", "MEDIUM"), (4, "P001", "MEDIUM"))),
    ("x = f.read()\ny = f.read(10)\nz = f.readlines()", ((1, "P002", "MEDIUM"), (3, "P002", "MEDIUM"))),
    ("s = ''\nfor i in y:\n    s += i\n    n += 1\nwhile y:\n    s = s + 'a'", ((3, "P003", "LOW"), (6, "P003", "LOW"))),
    ("list(range(3))\ntuple(map(f, x))\nlist(x)", ((1, "P004", "LOW"), (2, "P004", "LOW"))),
    ("for i in y:\n    re.compile('a')\nre.compile('a')", ((2, "P005", "MEDIUM"),)),
    ("for i in y:\n    a.b.c.d\n    a.b", ((2, "P006", "LOW"),)),
    ("for i in y:\n    len(z)\n    len(i)\n    z2 = 1\n    abs(z2)", ((2, "P007", "LOW"),)),
    ("for k in y:\n    try:\n        x = d[k]\n    except KeyError:\n        pass", ((2, "P008", "LOW"),)),
    ("for k, v in d.items():\n    print(k)\nfor k, v in d.items():\n    print(k, v)", ((1, "P009", "LOW"),)),
    ("SIZE = 3\nfor i in y:\n    print(SIZE)\nprint(SIZE)", ((3, "P010", "LOW"),)),
    ("b = b'xx'\nwhile x:\n    b[1:2]\nb[1:2]", ((3, "P011", "LOW"),)),
    ("NAMES = ['a', 'b']\nnames = ['a']", ((1, "P012", "LOW"),)),
    ("for a in b:\n    r.append(a)\nfor a in b:\n    if a:\n        d[a] = 1\nfor a in b:\n    f(a)", ((1, "P013", "MEDIUM"), (3, "P013", "MEDIUM"))),
    ("pd.read_csv('f')\npd.read_csv('f', chunksize=5)", ((1, "P015", "LOW"),)),
    ("x = 1\nprint(x)", ()),
)

_T = "Ab3" * 40
#: Line of code, its secret (rule id, severity, confidence) or none.
SECRETS: tuple[tuple[str, tuple[str, str, int] | None], ...] = (
    ('aws_access_key_id = "ABCDEFGHIJ0123456789"', ("S101", "HIGH", 90)),
    ('aws_secret_access_key = "' + _T[:40] + '"', ("S102", "CRITICAL", 95)),
    ('k = "AIza' + _T[:35] + '"', ("S113", "HIGH", 90)),
    ('heroku_api_key = "01234567-89ab-cdef-0123-456789abcdef"', ("S114", "HIGH", 90)),
    ('k = "ghp_' + _T[:36] + '"', ("S104", "CRITICAL", 95)),
    ('k = "gho_' + _T[:36] + '"', ("S105", "CRITICAL", 95)),
    ('k = "ghs_' + _T[:36] + '"', ("S106", "CRITICAL", 95)),
    ('k = "glpat-' + _T[:20] + '"', ("S107", "CRITICAL", 95)),
    ('k = "xoxb-' + _T[:12] + '"', ("S108", "HIGH", 90)),
    ('k = "xoxp-' + _T[:12] + '"', ("S109", "HIGH", 90)),
    ('k = "sk_live_' + _T[:24] + '"', ("S110", "CRITICAL", 95)),
    ('k = "sk_test_' + _T[:24] + '"', ("S111", "MEDIUM", 50)),
    ('k = "SG.' + _T[:22] + "." + _T[:43] + '"', ("S115", "HIGH", 90)),
    ('k = "SK0123456789abcdef0123456789abcdef"', ("S116", "HIGH", 90)),
    ('k = "M' + _T[:23] + "." + _T[:6] + "." + _T[:27] + '"', ("S119", "HIGH", 90)),
    ('api_key = "' + _T[:21] + '"', ("S103", "HIGH", 80)),
    ('k = "-----BEGIN RSA PRIVATE KEY-----"', ("S112", "CRITICAL", 95)),
    ('k = "npm_' + _T[:36] + '"', ("S117", "HIGH", 90)),
    ('k = "pypi-' + _T[:52] + '"', ("S118", "HIGH", 90)),
    ("k = 'postgres://me:word@host/db'", ("S120", "CRITICAL", 95)),
    ('k = "sk-ant-api03-' + (_T * 2)[:93] + '"', ("S121", "CRITICAL", 97)),
    ('jwt_secret = "abcdefgh"', ("S122", "CRITICAL", 92)),
    ('# k = "ghp_' + _T[:36] + '"', ("S104", "CRITICAL", 85)),
    ('k = "ghp_' + _T[:36] + '"  # noqa', None),
    ('k = "ghp_' + _T[:36] + '"  # pragma: no codeloom', None),
    ('k = "ghp_' + _T[:36] + '"  # pragma: no branch', ("S104", "CRITICAL", 95)),
    ('k = "ghp_' + _T[:36] + '"  # pragma: no mypy', ("S104", "CRITICAL", 95)),
    ('k = os.environ["X"] or "ghp_' + _T[:36] + '"', None),
    ('k = "ghp_' + _T[:36] + '", "http://x"', None),
    ('k = "ghp_' + _T[:36] + '", "example"', ("S104", "CRITICAL", 65)),
    ('k = "ghp_' + _T[:36] + '"  # an example xxx', ("S104", "CRITICAL", 95)),
    ('k = "ghp_' + _T[:36] + '" "${A}"', ("S104", "CRITICAL", 65)),
    ("password = 'correct-horse'", ("S300", "MEDIUM", 70)),
    ("self.apiKey = 'correct-horse'", ("S300", "MEDIUM", 70)),
    ("d['auth'] = 'correct-horse'", ("S300", "MEDIUM", 70)),
    ("keyboard = 'correct-horse'", None),
    ("monkey = 'correct-horse'", None),
    ("password = 'changeme'", None),
    ("password_regex = 'correct-horse'", None),
    ("jwt_token = 'correct-horse'", None),
    ('k = "q8Zr1LmN0pYw5KtB7vXeA2cD4fGh"', ("S200", "MEDIUM", 60)),
    ('k = "plain words in a row here"', None),
    ('k = "01234567-89ab-cdef-0123-456789abcdef"', None),
    ("x = 1", None),
)


def snippet_sources(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """``(path, source)``: the text of each part's number after 0 to 2 blank lines."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k")), "k")
    chosen = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("k") % len(texts) + 1).cast("int"))
    return part.select(F.concat(F.lit("c"), F.col("k").cast("string"), F.lit(".py")).alias("path"), F.concat(F.repeat(F.lit("\n"), (F.col("k") % 3).cast("int")), chosen).alias("source"))


def expected_sql(rows: list[tuple], columns: str, out: str, count: int) -> str:
    """SQL for the listed rows (number of the text, line, ...) of every part."""
    quoted = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT 'c' || p_partkey || '.py' AS path, CAST(line + p_partkey % 3 AS BIGINT) AS line, {out} FROM part JOIN (VALUES {quoted}) AS e(nth, line, {columns}) ON p_partkey % {count} = nth"
