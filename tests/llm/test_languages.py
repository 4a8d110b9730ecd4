"""Texts, places and names of scripts other than Latin, and names that only short words make up."""

import pytest

from sievemill.llm.names import organisations, tokens_of
from sievemill.llm.places import named_places, osa, repaired_tokens
from sievemill.llm.quality import LABELS, _paths, _scores, label_lines, lines_of

COMMON = frozenset("the of and to in is was for on that with as it by at this from be are or an we our you".split())
PROSE = {
    "zh": "我们正在寻找一位经验丰富的数据工程师加入我们的团队。您将负责设计和维护大规模的数据处理系统，并与产品经理密切合作。\n这个职位需要良好的沟通能力，以及对分布式系统的深入了解。我们提供有竞争力的薪酬和灵活的工作时间。",
    "ja": "私たちは経験豊富なデータエンジニアを探しています。大規模なデータ処理システムの設計と保守を担当していただきます。\nこの仕事では、製品チームと緊密に協力することが求められます。勤務時間は柔軟に調整できます。",
    "th": "เรากำลังมองหาวิศวกรข้อมูลที่มีประสบการณ์เพื่อเข้าร่วมทีมของเรา คุณจะรับผิดชอบในการออกแบบและดูแลระบบประมวลผลข้อมูลขนาดใหญ่\nตำแหน่งนี้ต้องการทักษะการสื่อสารที่ดีและความเข้าใจอย่างลึกซึ้งเกี่ยวกับระบบแบบกระจาย",
    "ar": "نحن نبحث عن مهندس بيانات ذي خبرة للانضمام إلى فريقنا في المدينة. ستكون مسؤولا عن تصميم وصيانة أنظمة معالجة البيانات الكبيرة.\nتتطلب هذه الوظيفة مهارات تواصل جيدة وفهما عميقا للأنظمة الموزعة. نقدم راتبا تنافسيا وساعات عمل مرنة.",
    "ru": "Мы ищем опытного инженера данных, который присоединится к нашей команде. Вы будете отвечать за проектирование и поддержку систем обработки данных.\nЭта работа требует хороших навыков общения и глубокого понимания распределённых систем.",
    "hi": "हम अपनी टीम में शामिल होने के लिए एक अनुभवी डेटा इंजीनियर की तलाश कर रहे हैं। आप बड़े पैमाने की प्रणालियों के डिजाइन के लिए जिम्मेदार होंगे।\nइस काम के लिए अच्छे संचार कौशल और वितरित प्रणालियों की गहरी समझ की आवश्यकता है।",
}
LISTS = {"zh": "• 软件工程师\n• 数据分析\n• 项目管理\n• 上海", "ru": "- Инженер\n- Анализ данных\n- Москва\n- Обучение", "ar": "• مهندس\n• محلل بيانات\n• القاهرة\n• تدريب"}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_prose_of_any_language(lang):
    assert {label for _, label in label_lines(PROSE[lang], COMMON)} == {"prose"}


@pytest.mark.parametrize("lang", sorted(LISTS))
def test_lists_of_any_language(lang):
    assert {label for _, label in label_lines(LISTS[lang], COMMON)} == {"list"}


def test_a_batch_is_labelled_as_its_documents():
    import numpy as np

    texts = [*PROSE.values(), *LISTS.values(), "a\tb\tc\nd\te\tf\n", "%%% ### @@@", "x"]
    lines = [lines_of(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    flat = [line for x in lines for line in x]
    path = _paths(_scores(flat, doc, COMMON), doc)
    assert [LABELS[t] for t in path] == [label for t in texts for _, label in label_lines(t, COMMON)]


PLACES = [(1, "東京", "13", "東京都", "JP", "Japan"), (2, "Łódź", "LD", "Łódzkie", "PL", "Poland"), (3, "Goma", "NK", "Nord-Kivu", "CD", "Democratic Republic of the Congo"), (4, "Goma", "GA", "Georgia", "US", "United States"), (5, "Straße", "BY", "Bavaria", "DE", "Germany"), (6, "Москва", "MOW", "Москва", "RU", "Russia")]
LOCATIONS = {"東京": [1], "Lodz, Poland": [2], "ŁÓDŹ": [2], "Goma, Democratic Republic of the Congo": [3], "Goma, Georgia": [4], "Strasse, Germany": [5], "Масква": [6], "大阪": []}


def test_places_of_any_script(spark):
    places = spark.createDataFrame(PLACES, "place_id int, city string, region_code string, region string, country_code string, country string")
    got = {r["location"]: sorted(r["place_ids"]) for r in named_places(spark.createDataFrame([(x,) for x in LOCATIONS], "location string"), places).collect()}
    assert got == LOCATIONS


def test_long_words_are_repaired(spark):
    words = ["abcdefghijklmnopqrstuvwxyzabcdefghij", "llanfairpwllgwyngyllgogerychwyrndrobwll"]
    slips = [f for w in words for f in (w[:3] + w[4:], w[:9] + w[10] + w[9] + w[11:-1], "x" + w + "y", w[:20] + "q" + w[20:], w[2:], w[3:])]
    got = {(r["token"], r["word"]) for r in repaired_tokens(spark.createDataFrame([(t,) for t in slips], "token string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(t, w) for t in slips for w in words if osa(t, w, 2) <= 2}


def test_short_and_foreign_names(spark):
    groups = [["HP", "HP Inc."], ["3M", "3M Company", "3m"], ["東京電力", "東京電力 Ltd"], ["Royal Northern Harbour Bank Trust Fund", "Royal Northern Harbour Bank Trust Fund Ltd", "The Royal Northern Harbour Bank Trust Fund"], ["Żółć Zibreta", "Zolc Zibreta"]]
    found = {}
    for r in organisations(spark.createDataFrame([(n,) for g in groups for n in g], "company string")).collect():
        found.setdefault(r["organisation"], set()).add(r["company"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups))
    assert tokens_of("Ørsted Ænergy") == ["orsted", "aenergy"]


def test_lines_of_business_are_learnt(spark):
    """Other words than those of any list: the names show what ends many of them, and slips still meet."""
    import random

    from sievemill.llm.names import spelling_classes

    draw = random.Random(4)
    word = lambda: "".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(3)) + draw.choice("nrls")
    lines = ["breweries", "upholstery", "falconry", "glassworks", "orchards"]
    base = sorted({f"{word()} {word()}".title() + " " + draw.choice(lines).title() for _ in range(150)})
    rows, owner = [], {}
    for i, name in enumerate(base):
        a, b, line = name.split()
        k = draw.randrange(1, len(b) - 1)
        for spelling in (name, f"{a} {b[:k]}{b[k + 1 :]} {line}", name.upper(), f"{b}, {a} {line}" if i % 2 else f"{a}-{b} {line} Ltd", f"{a} {b} {line[:4]}."):
            if spelling not in owner:
                rows.append((spelling,))
                owner[spelling] = i
    got = {r["company"]: r["organisation"] for r in spelling_classes(spark.createDataFrame(rows, "company string"), spark.createDataFrame([], "company string"), lines=frozenset()).collect()}
    names = sorted(owner)
    true = {(a, b) for a in names for b in names if a < b and owner[a] == owner[b]}
    told = {(a, b) for a in names for b in names if a < b and got[a] == got[b]}
    assert len(true & told) / len(true) > 0.9 and len(true & told) / len(told) > 0.95
