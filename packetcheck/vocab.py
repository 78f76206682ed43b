"""Fixed values of the document formats: labels, words, messages, limits.

Everything here must stay equal to what the documents and their consumers
use, so it is listed plainly and kept in one place.
"""

# --- packet roles -----------------------------------------------------------
RESERVED_DIRS = [
    "cache", "success", "success_projects", "export",
    "debug", "file", "sql", "project",
]
STATE_FILE = "project_compare_state.sqlite3"
REGISTRY_ROLE = ("关闭移交登记表", ["xls", "xlsx"])
SUMMARY_ROLE = ("竣工总结报告", ["doc", "docx"])
REPORT_ROLE = ("竣工验收报告", ["pdf", "jpg", "jpeg", "png"])

# --- registry sheet ---------------------------------------------------------
FIELD_HEADER = "字段名称"
CONTENT_HEADER = "内容"
SHEET_TITLE = "项目关闭登记表"
REMARK = "备注"
NOTE_PREFIX = "注："
REGISTRY_LABELS = [
    "项目编号", "项目全称", "产品线", "项目类型", "老项目编号", "软件版本",
    "合同额（万元）", "核实方式", "核实人", "项目部", "项目经理", "移交人",
    "接收日期", "核实日期", "完成日期", "用户联系人", "用户职务",
    "用户联系方式", "验收报告", "CRM有无信息", "CRM有无信息关联主项目号",
    "验收日期",
]
NAME_ALIASES = ["用户联系人", "用户姓名", "联系人"]
PHONE_ALIASES = ["用户联系方式", "联系电话", "联系方式"]
DATE_LABELS = ["验收日期", "完成日期", "核实日期"]
AMOUNT_LABEL = "合同额（万元）"

# registry label -> success ledger header
LEDGER_HEADERS = {
    "项目编号": "项目编码",
    "项目全称": "项目全称",
    "产品线": "产品线",
    "项目类型": "项目类型",
    "老项目编号": "老项目号",
    "软件版本": "软件版本",
    "合同额（万元）": "合同额（万元）",
    "核实方式": "核实方式",
    "核实人": "核实人",
    "项目部": "项目部",
    "项目经理": "项目经理",
    "移交人": "移交人",
    "接收日期": "接收日期",
    "核实日期": "核实日期",
    "完成日期": "完成关闭",
    "用户联系人": "联系人",
    "用户职务": "职务",
    "用户联系方式": "联系方式",
    "验收报告": "验收报告",
    "CRM有无信息": "CRM有无信息",
    "CRM有无信息关联主项目号": "CRM有无信息关联主项目号",
    "验收日期": "验收日期",
}
LEDGER_CODE = "项目编码"

# --- summary text -----------------------------------------------------------
SUMMARY_ANCHORS = ["项目编号", "项目全称", "用户姓名", "联系电话", "竣工验收"]
START_LABELS = ["竣工验收(开始时间)", "竣工验收（开始时间）", "竣工验收开始时间"]
END_LABELS = ["竣工验收(完成时间)", "竣工验收（完成时间）", "竣工验收完成时间"]
# labels that end a value
SUMMARY_CODE_STOPS = ["报告日期", "项目全称"]
SUMMARY_TITLE_STOPS = ["项目类型", "项目关注", "用户姓名"]
SUMMARY_NAME_STOPS = ["用户姓名", "用户职务", "联系电话", "电子邮件"]
SUMMARY_PHONE_STOPS = ["联系电话", "电子邮件", "项目经理", "所属部门", "竣工验收", "用户姓名"]

# Date as it appears in documents: digits may be split by blanks.
SPLIT_DATE = (
    r"(?:\d\s*){4}年\s*(?:\d\s*){1,2}月\s*(?:\d\s*){1,2}日"
    r"|(?:\d\s*){4}\s*[-/.]\s*(?:\d\s*){1,2}\s*[-/.]\s*(?:\d\s*){1,2}"
)
SIGN_DATE = (
    r"(?:\d\s*){4}年\s*(?:\d\s*){1,2}月\s*(?:\d\s*){1,2}日"
    r"|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
)
SIGN_DATE_DAY_FIRST = r"(\d{1,2})\s*日\s*(\d{4})\s*年\s*(\d{1,2})\s*月"
REPORT_CODE = r"[A-Z]{2,4}-\d{6,8}(?:[-/][A-Z0-9]+)+"
PHONE = r"1\d{10}"

# --- report text ------------------------------------------------------------
# (label, labels that end its value), tried in order
SIGNER_RULES = [
    ("签字人姓名", ["签字人姓名", "签字/盖章", "联系电话", "电话", "签字时间", "日期"]),
    ("签字/盖章", ["签字/盖章", "联系电话", "电话", "签字时间", "日期"]),
]
PHONE_LABELS = ["联系电话", "电话"]
PHONE_STOPS = ["签字人姓名", "签字/盖章", "联系电话", "电话", "签字时间", "日期"]

# --- portal pages -----------------------------------------------------------
ENTITIES = [
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"),
    ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
]
ATTACHMENT_SECTION = "关闭依据附件"
ATTACHMENTS_KEPT = 3
TOTAL_COUNT_KEYS = ["total", "totalCount", "recordCount", "records"]
TOTAL_PAGE_KEYS = ["totalPage", "totalPages", "pageCount"]
LOGIN_MARKERS = [
    "location.href = '/login.jsp",
    "location.href='/login.jsp",
    'name="j_username"',
    'name="password"',
]
EXPIRED_PHRASES = [
    "请先登录", "未登录", "重新登录", "登录超时", "登录已超时", "会话已失效",
    "会话失效", "login.jsp", "session expired", "session timeout",
    "not logged in", "login required",
]
WINDOWS_RESERVED = [
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]
SAFE_NAME_BYTES = 120

# --- recognition payloads ---------------------------------------------------
NAME_KEYS = ["signer_name", "matched_name"]
PHONE_KEYS = ["signer_phone", "matched_phone"]
DATE_KEYS = ["sign_date", "matched_date"]
NAME_CONFIDENCE_KEYS = [
    "signer_name_confidence", "name_confidence", "matched_name_confidence",
]
PHONE_CONFIDENCE_KEYS = [
    "signer_phone_confidence", "phone_confidence", "matched_phone_confidence",
]
DATE_CONFIDENCE_KEYS = [
    "sign_date_confidence", "date_confidence", "matched_date_confidence",
]
OCR_FAILED = "OCR 服务返回失败"
AI_UNAVAILABLE = "AI 识别不可用"

# --- report and logs --------------------------------------------------------
UNRECOGNIZED = "未识别"
DASH = "—"
OK_MARK = "✅"
BAD_MARK = "❌"
RESULT_ROW = "比对结果"
LOG_PREFIX = "[项目比对] "
CACHE_TAG = "[缓存]"
COLLECT_TAG = "[网页阶段] "
COLLECT_SUMMARY = r"\[网页阶段\] 完成: 下载=(\d+) \| 跳过=(\d+) \| 错误=(\d+)"
COLLECT_NOTHING = "[网页阶段] 未发现待下载项目，请确认当前登录账号和待办列表"
STAMP_THRESHOLD = 50.0
RED_RATIO = 0.01
