"""The policy that a model judges by, and the words that windows are rendered with, in two languages."""

from __future__ import annotations

from dataclasses import dataclass

from skeinwork.functions.scalars import fnv


@dataclass(frozen=True)
class Profile:
    """Facts about the owner; each only softens the policy, and is absent if None."""

    occupation: str | None = None
    account_country: str | None = None
    travel_country: str | None = None


@dataclass(frozen=True)
class Words:
    tag: str
    policy: str
    profile_head: str
    occupation: str
    account: str
    travel: str
    chat: str
    untitled: str
    tier: str
    tiers: tuple[str, str, str]
    axes: str
    log: str
    me: str
    them: str
    voice: str
    no_text: str
    protected: str
    fired: str
    ask: str


@dataclass(frozen=True)
class Prompt:
    id: str
    text: str


ENGLISH = Words(
    tag="en",
    policy="You review one window of the owner's own message archive.\n\n{PROFILE}Name ranges of message ids that the owner may want removed, each with an axis, a confidence from 0 to 1 and a reason. "
    "Leave marked keep-list messages alone. Prefer small ranges. Ask for more context only if the window cannot be judged without it. Answer with the JSON object of the schema and nothing else.",
    profile_head="About the owner:",
    occupation="- Occupation: {}. Talk about it is work and stays.",
    account="- Only accounts held in {} matter.",
    travel="- Talk about travel to {} is kept.",
    chat="Chat",
    untitled="untitled",
    tier="Age",
    tiers=("recent", "within a year", "older than a year"),
    axes="Axes",
    log="Messages:",
    me="me",
    them="them",
    voice="voice",
    no_text="no text",
    protected="    (keep-list: do not remove)",
    fired="    (rules: ",
    ask="Which ranges, if any?",
)
RUSSIAN = Words(
    tag="ru",
    policy="Вы просматриваете одно окно архива сообщений его владельца.\n\n{PROFILE}Назовите диапазоны id сообщений, которые владелец может захотеть убрать: для каждого ось, уверенность от 0 до 1 и причину. "
    "Сообщения с пометкой «хранить» не трогайте. Предпочитайте короткие диапазоны. Просите больше контекста, только если без него судить нельзя. Ответ: только объект JSON по схеме.",
    profile_head="О владельце:",
    occupation="- Занятие: {}. Разговоры о нём рабочие и остаются.",
    account="- Важны только счета в стране: {}.",
    travel="- Разговоры о поездке остаются: {}.",
    chat="Чат",
    untitled="без названия",
    tier="Возраст",
    tiers=("недавнее", "в пределах года", "старше года"),
    axes="Оси",
    log="Сообщения:",
    me="я",
    them="собеседник",
    voice="голос",
    no_text="без текста",
    protected="    (хранить: не убирать)",
    fired="    (правила: ",
    ask="Какие диапазоны, если такие есть?",
)
LANGUAGES = {w.tag: w for w in (ENGLISH, RUSSIAN)}


def words(language: str) -> Words:
    if language not in LANGUAGES:
        raise ValueError(f"unknown language: {language}")
    return LANGUAGES[language]


def build_prompt(language: str = "en", profile: Profile = Profile(), policy: str | None = None) -> Prompt:
    """The policy with the profile's lines, and an id from its language and a hash of its text."""
    w = words(language)
    facts = ((profile.occupation, w.occupation), (profile.account_country, w.account), (profile.travel_country, w.travel))
    lines = [line.replace("{}", value) for value, line in facts if value is not None]
    about = "\n".join([w.profile_head, *lines, "", ""]) if lines else ""
    text = (policy or w.policy).replace("{PROFILE}", about)
    return Prompt(f"{w.tag}-{fnv(text):08x}", text)
