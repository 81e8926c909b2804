import pyarrow.parquet as pq
import pytest

from memspark.llm.residue import EXEMPLARS, STATUS, labelled

PLAIN = [f"The step {i} keeps the rows of the page and the notes of the user in the index. Service {i} is open to the team." for i in range(60)]
RESIDUE = {
    "template": ["Dear {{ name }},\nthe notes of the week are here.", "负责人：%TITLE%", "Next review: ???", "Owner: [TEAM LEAD]", "本周TBD_OWNER的进展由某某某汇总。", "Some prose first. Then {% block x %} stays."],
    "filler": ["Lorem ipsum dolor sit amet", "Notes.\n\nSample text. Sample text.", "测试测试测试测试", "blah blah blah", "asdf asdf asdf", "Velum ordo umbra cario sedra."],
    "error": ["502 Bad Gateway\nReference 3a", "ACCESS  DENIED", "Your session has expired. Please sign in again.", "页面不存在", "Seite nicht gefunden (404)", "Forb🙂idden"],
    "script": ["Please enable JavaScript to see the notes on this page.", "Loading... If nothing happens, check that scripts are allowed.", "请启用 JavaScript 后继续浏览"],
}
MENTIONS = [
    "The renderer replaces `{{ name }}` with the stored value.", "In the launcher, ${NAME} is expanded by the shell before the tool reads it.", "The form shows \"undefined\" when the name is missing.", "We traced the 404 on the view to a missing prefix and fixed the route.",
    "A 502 from the gateway came back 14 times last night.", "Users who saw \"session has expired\" were logged out by a clock.", "Reviewers asked us to drop the lorem ipsum block from the fixture.", "The banner that asks users to enable JavaScript is now shown once per session only.",
    "用户反馈“请启用 JavaScript”的提示过于显眼，我们调整了样式。", "__init__ and __main__ are skipped.", "=" * 80, "0" * 500, "....", "🙂" * 40, "<|endoftext|>", "9f" * 300, " \n\t ", "def f(rows, limit=583):", "log.info(f\"{n} rows kept\")",
]
SCHEMA = "doc_id long, text string, residue string, _text2 string"


@pytest.fixture(scope="module")
def found(spark):
    texts = [*PLAIN, *MENTIONS, *[t for v in RESIDUE.values() for t in v], None, "", "x" * 100000]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, "404 Not Found", "a", "b"), (0, texts[0], "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = labelled(df, ["doc_id"], "text").collect()
    assert len(got) == len(rows)
    return {(texts[r.doc_id] if r.doc_id is not None else "keyless"): r.residue for r in got}


@pytest.mark.parametrize(("label", "text"), [(k, t) for k, v in RESIDUE.items() for t in v])
def test_residue(found, label, text):
    assert found[text] == label


def test_nothing_else(found):
    assert [t for t in [*PLAIN, *MENTIONS, None, "", "x" * 100000] if found[t]] == []
    assert found["keyless"] == "error"


def test_levels_and_typed_placeholders_are_content(spark):
    content = ["[INFO] started", "[ERROR] disk full on node 7", "2025-01-02 [WARN] retry 3", "Mail [EMAIL] or call [PHONE].", "[PERSON] signed off", "Owner: [PERSON]", "Moved to [ADDRESS]", "The [DRAFT] of the notes is kept in the index"]
    residue = ["Owner: [NAME]", "Dear [CUSTOMER],", "Date: [DATE]"]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate([*content, *residue, *PLAIN])], SCHEMA)
    found = {r.doc_id: r.residue for r in labelled(df, ["doc_id"], "text").filter("residue IS NOT NULL").collect()}
    assert found == {len(content) + i: "template" for i in range(len(residue))}


# Texts that known programs print and no exemplar was written from. Of the first 48 the operator found 42 when they were
# tried first and of the first FRESH 24 of 31; words of meaning were added after each. LAST was tried when all was done.
HELD_OUT = {
    "error": [
        "We're sorry, the page you requested cannot be found.", "The requested URL /index was not found on this server.", "This site can’t be reached", "403 Forbidden\nnginx/1.18.0", "HTTP Status 500 – Internal Server Error", "Whitelabel Error Page", "Service Temporarily Unavailable",
        "The server is temporarily unable to service your request due to maintenance downtime.", "Checking if the site connection is secure", "Your session has timed out, please log in again.", "You don't have permission to access this resource.", "Error 429: rate limit exceeded, please try again later.", "Sorry, this post has been removed.",
        "Ein unerwarteter Fehler ist aufgetreten.", "Die angeforderte Seite wurde nicht gefunden.", "Sie haben keine Berechtigung.", "您没有权限访问该页面", "服务器内部错误", "请求过于频繁，请稍后再试", "找不到您访问的页面",
    ],
    "script": [
        "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.", "JavaScript is not available.", "This page requires JavaScript.", "Please turn on JavaScript in your browser settings to use this site.", "You need to enable JavaScript to run this app.", "JavaScript must be enabled to view this page.", "Bitte JavaScript einschalten, um die Seite anzuzeigen.", "您的浏览器不支持 JavaScript，请启用后重试", "本站需要启用 JavaScript",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Ut enim ad minima veniam, nostrum exercitationem ullam corporis suscipit laboriosam.", "Click to add text", "Enter your text here", "Type your description here", "This is placeholder text.", "qwer qwer qwer qwer", "在此处输入文字", "此处填写内容", "Platzhaltertext, bitte ersetzen.", "la la la la la la",
    ],
    "template": ["Hi {{first_name}},", "Copyright <%= year %> by ${OWNER}", "Sincerely, [YOUR NAME HERE]", "Total: %(amount)s", "Dear ____,", "Hello [CUSTOMER],", "甲方：【请填写公司】", "{% if user %}"],
}


FRESH = {
    "error": [
        "Oops, looks like the page is lost.", "The link you followed may be broken, or the page may have been removed.", "An internal server error occurred.", "Our servers are currently overloaded, please try again in a few minutes.", "You are not authorized to view this page.", "Unauthorized", "The service is temporarily down for maintenance.",
        "Too many login attempts. Try again later.", "Your login session has expired, please log in again.", "Verify you are human by completing the action below.", "Die Seite existiert nicht mehr.", "Der Server ist momentan überlastet, bitte später erneut versuchen.", "该网页无法访问", "会话已超时，请重新登录", "网站正在维护中，请稍后访问",
    ],
    "script": ["Your browser does not support JavaScript.", "JavaScript is disabled. Please enable it and reload the page.", "To view this site you must have JavaScript turned on.", "Diese Seite benötigt JavaScript.", "请在浏览器中启用脚本"],
    "filler": ["Add your text here", "Insert description here", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem.", "xx xx xx xx xx", "示例文字，请替换"],
    "template": ["Dear {{ customer.name }},", "Invoice for ${client}", "[Insert date here]", "Author: TBD", "{%- block content -%}", "Best regards, <%= sender %>"],
}


LAST = {
    "error": [
        "Sorry, we couldn't find that page.", "This content is no longer available.", "The document you are looking for has been moved or deleted.", "502 Proxy Error", "The connection has timed out", "We are currently performing scheduled maintenance.", "An unexpected error has occurred. Please try again later.", "Forbidden: you do not have access to this resource.",
        "Please log in to view this page.", "Rate limit exceeded. Retry in 30 seconds.", "Server error. Please contact the administrator.", "Zugriff auf diese Seite verweigert.", "Bitte versuchen Sie es später erneut.", "页面已被删除", "网络连接超时，请重试", "您无权访问该资源",
    ],
    "script": ["This application requires JavaScript to be enabled.", "Without JavaScript this page cannot be displayed.", "Scripts are blocked by your browser.", "Aktivieren Sie bitte JavaScript in Ihrem Browser.", "请打开浏览器的 JavaScript 功能"],
    "filler": ["Your text goes here", "Replace this text with your own content.", "Neque porro quisquam est qui dolorem ipsum quia dolor sit amet.", "ha ha ha ha ha", "请在此输入正文"],
    "template": ["Hello {{user_name}}, welcome back.", "Ref: %(ticket)s", "Signed: [FULL NAME]", "Title: ____", "{{#each items}}", "<%= title %>"],
}


@pytest.mark.parametrize("lists", [HELD_OUT, FRESH, LAST], ids=["held_out", "fresh", "last"])
def test_held_out(spark, lists):
    texts = [(label, t) for label, own in lists.items() for t in own]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate([*[t for _, t in texts], *PLAIN])], SCHEMA)
    got = {r.doc_id: r.residue for r in labelled(df, ["doc_id"], "text").collect()}
    missed = [t for i, (_, t) in enumerate(texts) if got[i] is None]
    assert len(missed) <= 0.1 * len(texts), missed
    assert not [i for i in range(len(texts), len(texts) + len(PLAIN)) if got[i]]


def test_no_exemplar_stands_in_the_tables():
    """But for what HTTP itself says, and single words."""
    docs = "\n".join(t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t).lower()
    own = [t for texts in EXEMPLARS.values() for t in texts if not any(s.lower().replace("-", " ") in t for s in STATUS)]
    assert not [t for t in own if len(t.split()) > 3 and "?" not in t and t in docs]


def test_placeholders_of_any_length_and_long_runs(spark):
    long = ["Dear {{ " + "very_long_name_" * 40 + "}},", "{{" * 50000, "`" * 100000, "«" * 100000, "[" * 100000 + "insert", "<% " * 30000, "a" * 200000]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate([*long, *PLAIN])], SCHEMA)
    got = {r.doc_id: r.residue for r in labelled(df, ["doc_id"], "text").collect()}
    assert got[0] == "template" and not [got[i] for i in range(len(long), len(long) + len(PLAIN)) if got[i]]


def test_empty(spark):
    assert labelled(spark.createDataFrame([], SCHEMA), ["doc_id"], "text").count() == 0
