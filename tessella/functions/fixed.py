"""Words, patterns and weights that results depend on, and a place for a corpus's own.

Values that name an institution are not here: they belong to the corpus and are given with ``Domain``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Characters of the mixed-script tokeniser.
ASCII_TOKEN = r"[a-zA-Z][a-zA-Z0-9_+#.-]*|\d+(?:\.\d+)?"
ASCII_TOKEN_WIDE = r"[a-zA-Z][a-zA-Z0-9_+#.@/-]*|\d+(?:\.\d+)?"
INDEX_PART = r"[\p{L}\p{N}]+"
CJK_RUN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
CJK_STOP = "的一是在了和与及或对中为有个们于年月日"

# Patterns of things found in text.
URL = r"https?://[^\s)\]>\"']+"
DATE = r"(20\d{2})[-_/年.](\d{1,2})(?:[-_/月.](\d{1,2}))?"
EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
COURSE_CODE = r"\b[A-Z]{2,}\d{2,4}[A-Z]?\b"
YEAR = r"20\d{2}"
HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*$"
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"

# Lines that are page furniture wherever they stand.
NOISE_LINES = ("导航", "导航菜单", "### 导航", "### 网站导航", "### 语言", "网站导航", "站内搜索", "Menu", "EN", "中文", "English", "Newsletter", "新闻", "通知公告", "友情链接", "更多+", "官方微信", "学校首页", "首 页", "首页", "返回", "返回顶部", "None", "!", "! !", "版权所有", "[](javascript:;)", "[ ](javascript:;)", "[返回](javascript:;)原图", "---", "| --- |", "| --- | --- |")
NOISE_LINES_2 = ("导航", "网站导航", "站内搜索", "首 页", "首页", "返回", "返回顶部", "中文", "English", "EN", "Menu", "Newsletter", "更多+", "Copyright", "版权所有", "打印", "关闭", "分享到", "扫一扫", "官方微信", "学校首页", "学院首页", "学院概况", "使命和愿景", "学院介绍", "院长寄语", "顾问委员会", "院务委员会", "科学研究", "研究中心", "联合实验室", "省部级研究中心", "规章制度", "采购公告", "EHS", "最新动向", "常用资料", "科研设备", "师资队伍", "常任教授", "特聘教授", "访问教授", "研究人员", "支撑人员", "行政人员", "学生培养", "本科生培养", "研究生培养", "毕业答辩流程", "培养方案", "培养与学位授予相关细则", "远程答辩公示", "本硕博课程体系", "本科生教学教务", "研究生教学教务", "技能培训", "学生风采", "资料下载", "招生工作", "本科生招生", "研究生招生介绍一览", "硕士研究生招生", "博士研究生招生", "通知公告", "报考指南", "招生宣传", "师生风采", "招生Q&A", "暑期项目", "实习就业", "实习信息", "就业信息", "国际交流", "人才招聘", "Faculty Recruitment", "Researcher Recruitment", "Job Opportunities", "Undergraduate", "Graduate")
NOISE_LABELS = ("!", "En", "中文", "English", "官方微信", "新闻", "公告", "学校概况", "校务委员会", "校领导", "院所设置", "科学研究", "科研进展", "联系我们", "学校简介", "机构设置", "大事记", "影像报刊", "学校首页")
NOISE_PATTERNS = (r"^\s*浏览次数[:：]?\s*\d*\s*$", r"^\s*发布时间[:：]?\s*$", r"^\s*当前位置[:：]?\s*$", r"(?i)^\s*Copyright\b", r"^\s*沪公网安备", r"^\s*地址[:：].*邮编", r"^\s*(上一条|下一条|打印|关闭|分享|扫码分享)\s*$", r"^\s*\*?\s*\[[^\]]{0,24}\]\(javascript:;?\)\s*$", r"^\s*!\[[^\]]*\]\([^)]*\)\s*$", r"(?i)^\s*<img\b")
NOISE_PATTERNS_2 = (r"^\s*浏览次数[:：]?\s*\d*\s*$", r"^\s*发布时间[:：]?\s*$", r"^\s*当前位置[:：]?\s*$", r"^\s*沪公网安备", r"(?i)^\s*Copyright\b", r"^\s*地址[:：].*邮编[:：]?\s*\d+", r"^\s*(上一条|下一条|打印|关闭|分享)\s*$", r"^\s*!?\[[^\]]{0,40}\]\([^)]*\)\s*$", TABLE_RULE)
PLACEHOLDERS = ("中文", "EN", "English", "Menu", "None", "站内搜索", "网站导航")
STATIC_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".css", ".js", ".webp", ".bmp")
BINARY_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "svg", "ico", "webp", "css", "js", "woff", "woff2", "ttf", "eot", "pdf", "mp4", "mp3", "avi", "mov", "flv", "wmv", "zip", "rar", "tar", "gz", "bz2", "7z", "exe", "dmg", "pkg", "apk", "iso", "bin", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp")
NOT_FOUND = ("not found", "404 not found", "页面不存在", "无法找到", "请求的url未找到", "the requested url was not found", "page not found", "找不到", "http 404", "error 404")

# Terms that tell useful PDF files from papers.
PDF_KEEP = ("招生", "培养方案", "课程", "学位", "通知", "公告", "公示", "办法", "章程", "指南", "政策", "申请", "就业", "招聘", "采购", "招标", "报名", "奖学金", "规章")
PDF_ACADEMIC = ("abstract", "references", "arxiv", "doi", "ieee", "acm", "proceedings", "conference", "workshop", "slides", "poster", "acl", "emnlp", "iclr", "neurips", "cvpr", "iccv", "aaai", "ijcai", "iecon", "apec", "ecce", "ecceasia", "tpel", "tpe", "tie", "tia", "tvt", "mtt", "mwscas", "iscas", "icassp", "access", "jestpe", "ietpe", "iros", "icra")

# Marks of text decoded with the wrong charset.
MOJIBAKE = ("ä", "å", "ç", "è", "æ", "é", "ï1⁄4", "3⁄4")
MOJIBAKE_2 = ("ä", "å", "ç", "è", "æ", "é", "Ϣѧ", "רҵ", "ѧλ")
MISREAD = ("ϢѧԺ", "Ϣѧ", "רҵ", "ѧλ", "汾ŵ", "ھ", "ʦ", "ƽ", "о", "Ƹ", "εͳ")

# Confidence that a structured row needs, and the quality its table starts from.
CONFIDENCE = {"facts": 0.80, "leadership_roles": 0.82, "courses": 0.55, "events": 0.62, "program_requirements": 0.55, "program_sources": 0.60}
TABLE_QUALITY = {"faculty_members": 1.00, "courses": 0.92, "program_requirements": 0.90, "events": 0.86, "contacts": 0.86, "facilities": 0.86, "staff_members": 0.84, "program_sources": 0.78, "facts": 0.72, "leadership_roles": 0.68}

# Columns of structured rows, in order of preference.
TITLE_FIELDS = ("name", "name_en", "course_name", "course_name_en", "program_name", "subject", "summary", "title")
URL_FIELDS = ("source_url", "profile_url", "homepage", "detail_url", "url", "list_page_url")
ROW_TITLE_FIELDS = ("course_code", "code", "course_name", "name_cn", "name", "professor", "course_name_en", "title", "subject", "program_name")
ROW_FIELDS = ("school", "program_name", "cohort", "degree", "course_code", "code", "course_name", "name_cn", "course_name_en", "credits", "hours", "term", "semester", "instructor", "teacher", "teachers", "name", "name_en", "title", "role", "faculty_category", "research_area", "email", "phone", "office", "homepage", "profile_url", "event_type", "event_date", "published_at", "requirement_type", "requirement_text", "min_credits", "source_url")
DEDUP_FIELDS = {"courses": ("course_code", "course_name", "term", "instructor"), "contacts": ("name", "email", "phone", "office"), "faculty_members": ("name", "name_en", "email", "profile_url"), "leadership_roles": ("name", "role", "org", "status"), "program_requirements": ("program_name", "requirement_type", "requirement_text", "cohort"), "events": ("title", "event_date", "source_url")}
FIELD_LABELS = {"email": "邮箱 email", "phone": "电话 phone", "office": "办公室 office", "instructor": "任课老师 instructor", "credits": "学分 credits", "course_code": "课程编号 course code", "course_name": "课程名称 course name", "course_name_en": "英文课程名 course name english", "program_name": "专业 项目 program", "min_credits": "最低学分 min credits", "requirement_text": "要求 requirement", "requirement_type": "要求类型 requirement type", "research_area": "研究方向 research area", "role": "角色 职务 role", "title": "标题 title", "source_url": "来源 source url"}
ROW_LABELS = {"school": "学院/单位", "name": "姓名", "name_en": "英文名", "title": "职称/标题", "role": "职务", "faculty_category": "教师类别", "category": "类别", "research_area": "研究方向", "email": "邮箱", "phone": "电话", "office": "办公室", "homepage": "主页", "profile_url": "个人主页", "course_code": "课程代码", "code": "课程代码", "course_name": "课程名称", "name_cn": "课程名称", "course_name_en": "英文课程名", "credits": "学分", "hours": "学时", "term": "学期", "semester": "学期", "instructor": "任课教师", "teacher": "任课教师", "teachers": "任课教师", "program_name": "项目/专业", "program": "项目/专业", "cohort": "年级", "degree": "学位层次", "requirement_type": "要求类型", "requirement_text": "要求", "min_credits": "最低学分", "event_type": "事件类型", "event_date": "事件日期", "published_at": "发布日期", "source_url": "来源 URL", "url": "URL", "evidence": "证据片段"}

# Words of a query that carry no search term.
# Topics in questions: what stands before and behind one, what is cut off it, and what is none.
TOPIC_PATTERNS = (r"([\x{4e00}-\x{9fff}A-Za-z0-9+#.\- ]{2,24}?)(?:方向|领域|课题)", r"(?i)(?:想|要)?(?:找|做|研究|关注|从事)(?:研究)?([\x{4e00}-\x{9fff}A-Za-z0-9+#.\-、与及和 ]{2,32}?)(?:%s(?:老师|教师|导师|教授)|[，。？?])")
TOPIC_LEAD = r"^(?:我)?(?:想|要)?(?:做|找|研究|关注|有关|关于|适合|联系|推荐)+"
TOPIC_BREAKS = ("导师", "老师", "教授", "研究方向", "研究兴趣")
TOPIC_STOP = ("我想", "想做", "做机", "方向", "哪些", "导师", "可以", "推荐", "有哪", "老师", "教授", "教师", "研究", "领域", "课题", "个人", "主页", "邮箱", "办公室", "faculty", "advisor", "supervisor", "mentor", "research", "interests", "area", "areas")
TOPIC_NONE = ("如果", "是否", "匹配", "合适", "适合", "可以", "老师", "教师", "导师", "教授")
TOPIC_CHARS = "我想做究方向导师推荐可以哪些"
TOPIC_LATIN_STOP = ("about", "assistant", "campus", "course", "courses", "faculty", "homepage", "information", "instructor", "overview", "profile", "research", "school", "student", "students", "teacher", "university")
GENERIC_TERMS = ("请问", "告诉我", "帮我查", "查询", "一下", "about", "tell me", "introduce", "introduction")
EXPANSIONS = {"课程": ("course", "courses"), "任课老师": ("instructor", "teacher", "lecturer", "授课教师"), "老师": ("instructor", "teacher", "professor", "教师"), "导师": ("advisor", "supervisor", "professor", "faculty", "研究方向"), "学分": ("credit", "credits"), "毕业": ("graduation", "graduate"), "培养方案": ("degree program", "program requirements"), "邮箱": ("email", "mail"), "邮件": ("email", "mail"), "电话": ("phone", "tel"), "办公室": ("office",), "讲座": ("lecture", "talk", "seminar", "卓越讲座")}

# Weights of rankings.
BM25F_WEIGHTS = {"title": 3.0, "text": 1.0, "category": 0.8, "url": 0.2}
BM25F_B = {"title": 0.2, "text": 0.75, "category": 0.0, "url": 0.0}
SOURCE_PRIORITY = {"verified_seed": 7.0, "live_official": 6.2, "local_official_mirror": 5.0, "training": 5.0, "structured_json": 4.6, "structured_table": 4.4, "web": 2.8, "text_pages": 2.4, "pdf_md": 1.2}
#: Categories of structured chunks, of course lists and of contact lists.
STRUCTURED_CATEGORIES = ("courses", "sist_courses", "courses_clean", "courses_unified", "course_schedule", "course_teacher_map", "prof_courses_full", "faculty_members", "sist_faculty", "faculty", "faculty_merged", "all_faculty", "professors", "professors_clean", "professors_enriched", "contacts", "program_requirements", "program_sources", "program", "events", "news", "leadership", "leadership_roles", "university_overview", "university_contact", "sist_overview", "sist_degree_programs", "sist_news_events", "sist_research")
COURSE_CATEGORIES = ("courses", "sist_courses", "courses_clean", "courses_unified")
CONTACT_CATEGORIES = ("contacts", "faculty_members", "sist_faculty", "professors_enriched", "leadership", "leadership_roles")
# What tells the class of a hit; heads are characters of a text and the words sought there.
COURSE_EVIDENCE = ("courses", "sist_courses", "courses_clean", "courses_unified", "course_schedule", "course_teacher_map", "prof_courses_full")
PROFILE_EVIDENCE = ("contacts", "faculty", "faculty_members", "faculty_merged", "all_faculty", "leadership", "leadership_roles", "professors", "professors_clean", "professors_enriched", "program", "sist_faculty")
TEACHERS_LABEL, CODE_LABEL = "任课教师", "课程代码: "
LISTING_PATHS, PROFILE_PATHS, PROFILE_TITLES = ("courses", "schedule"), ("faculty", "main.htm"), ("homepage", "主页")
PROFILE_HEADS = ((1400, ("research interests", "contact me")), (1200, ("个人主页:", "研究方向:", "博士毕业院校:", "邮箱:", "办公室:")))
AFTER_NAMES = ("博士", "教授", "老师", "导师", "副教授", "研究员", "的")

# Boosts of source tiers and channel weights.
TIER_BOOST = {"verified_seed": 8.0, "live_official": 5.5, "local_official_mirror": 4.0, "llm_curated": 3.5}
TIER_QUALITY = {"verified_seed": 0.45, "live_official": 0.36, "local_official_mirror": 0.30, "llm_curated": 0.26}
RRF_WEIGHTS = {"lexical": 1.0, "structured": 1.15, "dense": 1.0}


@dataclass(frozen=True)
class Domain:
    """What belongs to one corpus: its hosts, categories, words and hand-made dictionaries. All may be empty."""

    hosts: tuple[str, ...] = ()
    host_suffixes: tuple[str, ...] = ()
    favoured_hosts: tuple[str, ...] = ()
    noise_hosts: tuple[str, ...] = ("arxiv.org", "doi.org")
    favoured_categories: tuple[str, ...] = ("faculty", "program", "admission")
    relevance_terms: tuple[str, ...] = ()
    noise_lines: tuple[str, ...] = ()
    expansions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    category_words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    path_categories: tuple[tuple[tuple[str, ...], str], ...] = ((("faculty", "professor", "师资"), "faculty"), (("course", "课程", "pyfa", "培养方案"), "program"), (("admission", "招生", "apply"), "admission"), (("career", "jobs", "招聘"), "career"), (("news", "新闻"), "news"))
