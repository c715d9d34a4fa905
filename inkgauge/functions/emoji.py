"""Emoji names by rule, for single characters and for the sequences that show as one emoji.

A character's name is its Unicode name in lower case, joined by underscores; where the common short name differs, OTHER_NAMES has
it. Sequences are named from their parts: skin tones, jobs, genders, families, keycaps, and flags by their region. A fuller
table (emoji -> name, without colons) can be passed in wherever names are used; it goes before the rules.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import cache

#: Blocks and single code points whose characters show as emoji. Fixed values.
RANGES = (
    (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x2199),
    (0x21A9, 0x21AA), (0x231A, 0x231B), (0x2328, 0x2328), (0x23CF, 0x23CF), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2), (0x25AA, 0x25AB),
    (0x25B6, 0x25B6), (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x2604), (0x260E, 0x260E),
    (0x2611, 0x2611), (0x2614, 0x2615), (0x2618, 0x2618), (0x261D, 0x261D), (0x2620, 0x2620), (0x2622, 0x2623),
    (0x2626, 0x2626), (0x262A, 0x262A), (0x262E, 0x262F), (0x2638, 0x263A), (0x2640, 0x2640), (0x2642, 0x2642),
    (0x2648, 0x2653), (0x265F, 0x2660), (0x2663, 0x2663), (0x2665, 0x2666), (0x2668, 0x2668), (0x267B, 0x267B),
    (0x267E, 0x267F), (0x2692, 0x2697), (0x2699, 0x2699), (0x269B, 0x269C), (0x26A0, 0x26A1), (0x26AA, 0x26AB),
    (0x26BD, 0x26BE), (0x26C4, 0x26C5), (0x26CE, 0x26CF), (0x26D4, 0x26D4), (0x26EA, 0x26EA), (0x26F2, 0x26F3),
    (0x26F5, 0x26F5), (0x26FA, 0x26FA), (0x26FD, 0x26FD), (0x2702, 0x2702), (0x2705, 0x2705), (0x2708, 0x270D),
    (0x270F, 0x270F), (0x2712, 0x2712), (0x2714, 0x2714), (0x2716, 0x2716), (0x271D, 0x271D), (0x2721, 0x2721),
    (0x2728, 0x2728), (0x2733, 0x2734), (0x2744, 0x2744), (0x2747, 0x2747), (0x274C, 0x274C), (0x274E, 0x274E),
    (0x2753, 0x2755), (0x2757, 0x2757), (0x2763, 0x2764), (0x2795, 0x2797), (0x27A1, 0x27A1), (0x27B0, 0x27B0),
    (0x27BF, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B07), (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55),
    (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F004, 0x1F004), (0x1F0CF, 0x1F0CF),
    (0x1F170, 0x1F171), (0x1F17E, 0x1F17F), (0x1F18E, 0x1F18E), (0x1F191, 0x1F19A), (0x1F201, 0x1F202), (0x1F21A, 0x1F21A),
    (0x1F22F, 0x1F22F), (0x1F232, 0x1F23A), (0x1F250, 0x1F251),
    (0x1F300, 0x1F321), (0x1F324, 0x1F393), (0x1F396, 0x1F397), (0x1F399, 0x1F39B), (0x1F39E, 0x1F3F0), (0x1F3F3, 0x1F3F5),
    (0x1F3F7, 0x1F4FD), (0x1F4FF, 0x1F53D), (0x1F549, 0x1F54E), (0x1F550, 0x1F567), (0x1F56F, 0x1F570), (0x1F573, 0x1F57A),
    (0x1F587, 0x1F587), (0x1F58A, 0x1F58D), (0x1F590, 0x1F590), (0x1F595, 0x1F596), (0x1F5A4, 0x1F5A5), (0x1F5A8, 0x1F5A8),
    (0x1F5B1, 0x1F5B2), (0x1F5BC, 0x1F5BC), (0x1F5C2, 0x1F5C4), (0x1F5D1, 0x1F5D3), (0x1F5DC, 0x1F5DE), (0x1F5E1, 0x1F5E1),
    (0x1F5E3, 0x1F5E3), (0x1F5E8, 0x1F5E8), (0x1F5EF, 0x1F5EF), (0x1F5F3, 0x1F5F3), (0x1F5FA, 0x1F64F), (0x1F680, 0x1F6C5),
    (0x1F6CB, 0x1F6D2), (0x1F6D5, 0x1F6D7), (0x1F6DC, 0x1F6E5), (0x1F6E9, 0x1F6E9), (0x1F6EB, 0x1F6EC), (0x1F6F0, 0x1F6F0),
    (0x1F6F3, 0x1F6FC),
    (0x1F7E0, 0x1F7EB), (0x1F90C, 0x1F93A), (0x1F93C, 0x1F945), (0x1F947, 0x1F9FF), (0x1FA70, 0x1FA7C),
    (0x1FA80, 0x1FA88), (0x1FA90, 0x1FABD), (0x1FABF, 0x1FAC5), (0x1FACE, 0x1FADB), (0x1FAE0, 0x1FAE8), (0x1FAF0, 0x1FAF8),
)

#: Common short names that differ from the Unicode name. Fixed values.
OTHER_NAMES = {
    "☀": "sun",
    "☎": "telephone",
    "☑": "check_box_with_check",
    "☕": "hot_beverage",
    "☺": "smiling_face",
    "♥": "heart_suit",
    "♻": "recycling_symbol",
    "⚠": "warning",
    "⚡": "high_voltage",
    "⚽": "soccer_ball",
    "✅": "check_mark_button",
    "✈": "airplane",
    "✔": "check_mark",
    "❄": "snowflake",
    "❌": "cross_mark",
    "❓": "red_question_mark",
    "❗": "red_exclamation_mark",
    "❤": "red_heart",
    "➡": "right_arrow",
    "⭐": "star",
    "🌍": "globe_showing_Europe-Africa",
    "🎉": "party_popper",
    "🏆": "trophy",
    "👀": "eyes",
    "👋": "waving_hand",
    "👍": "thumbs_up",
    "👎": "thumbs_down",
    "👏": "clapping_hands",
    "💡": "light_bulb",
    "💪": "flexed_biceps",
    "💯": "hundred_points",
    "📅": "calendar",
    "📈": "chart_increasing",
    "📉": "chart_decreasing",
    "📌": "pushpin",
    "📝": "memo",
    "🔍": "magnifying_glass_tilted_left",
    "🔥": "fire",
    "🙂": "slightly_smiling_face",
    "🙌": "raising_hands",
    "🙏": "folded_hands",
    "😀": "grinning_face",
    "😂": "face_with_tears_of_joy",
    "😉": "winking_face",
    "😊": "smiling_face_with_smiling_eyes",
    "😍": "smiling_face_with_heart-eyes",
    "😎": "smiling_face_with_sunglasses",
    "😢": "crying_face",
    "😭": "loudly_crying_face",
    "🤔": "thinking_face",
    "🤣": "rolling_on_the_floor_laughing",
    "🥳": "partying_face",
    "©": "copyright",
    "®": "registered",
    "™": "trade_mark",
    "‼": "double_exclamation_mark",
    "⁉": "exclamation_question_mark",
    "ℹ": "information",
    "↔": "left-right_arrow",
    "↕": "up-down_arrow",
    "↖": "up-left_arrow",
    "↗": "up-right_arrow",
    "↘": "down-right_arrow",
    "↙": "down-left_arrow",
    "↩": "right_arrow_curving_left",
    "↪": "left_arrow_curving_right",
    "⬅": "left_arrow",
    "⬆": "up_arrow",
    "⬇": "down_arrow",
    "⌚": "watch",
    "⌛": "hourglass_done",
    "⏰": "alarm_clock",
    "⏳": "hourglass_not_done",
    "☁": "cloud",
    "☂": "umbrella",
    "☃": "snowman",
    "☔": "umbrella_with_rain_drops",
    "☝": "index_pointing_up",
    "☠": "skull_and_crossbones",
    "☹": "frowning_face",
    "♀": "female_sign",
    "♂": "male_sign",
    "♠": "spade_suit",
    "♣": "club_suit",
    "♦": "diamond_suit",
    "⚖": "balance_scale",
    "⚕": "medical_symbol",
    "⛔": "no_entry",
    "✂": "scissors",
    "✉": "envelope",
    "✊": "raised_fist",
    "✋": "raised_hand",
    "✌": "victory_hand",
    "✍": "writing_hand",
    "✏": "pencil",
    "✖": "multiply",
    "✨": "sparkles",
    "✳": "eight-spoked_asterisk",
    "❎": "cross_mark_button",
    "❔": "white_question_mark",
    "❕": "white_exclamation_mark",
    "❣": "heart_exclamation",
    "➕": "plus",
    "➖": "minus",
    "➗": "divide",
    "⭕": "hollow_red_circle",
    "🌞": "sun_with_face",
    "🌟": "glowing_star",
    "🌹": "rose",
    "🍺": "beer_mug",
    "🍻": "clinking_beer_mugs",
    "🎁": "wrapped_gift",
    "🎂": "birthday_cake",
    "🎈": "balloon",
    "🎓": "graduation_cap",
    "🎯": "bullseye",
    "🏁": "chequered_flag",
    "🏃": "person_running",
    "🏠": "house",
    "🏳": "white_flag",
    "🏴": "black_flag",
    "🐛": "bug",
    "👇": "backhand_index_pointing_down",
    "👆": "backhand_index_pointing_up",
    "👈": "backhand_index_pointing_left",
    "👉": "backhand_index_pointing_right",
    "👊": "oncoming_fist",
    "👌": "OK_hand",
    "👐": "open_hands",
    "💀": "skull",
    "💖": "sparkling_heart",
    "💙": "blue_heart",
    "💥": "collision",
    "💩": "pile_of_poo",
    "💰": "money_bag",
    "💻": "laptop",
    "📊": "bar_chart",
    "📞": "telephone_receiver",
    "📧": "e-mail",
    "📱": "mobile_phone",
    "🔒": "locked",
    "🔗": "link",
    "🔧": "wrench",
    "😁": "beaming_face_with_smiling_eyes",
    "😃": "grinning_face_with_big_eyes",
    "😄": "grinning_face_with_smiling_eyes",
    "😅": "grinning_face_with_sweat",
    "😆": "grinning_squinting_face",
    "😇": "smiling_face_with_halo",
    "😋": "face_savoring_food",
    "😏": "smirking_face",
    "😐": "neutral_face",
    "😒": "unamused_face",
    "😔": "pensive_face",
    "😕": "confused_face",
    "😘": "face_blowing_a_kiss",
    "😜": "winking_face_with_tongue",
    "😡": "enraged_face",
    "😠": "angry_face",
    "😤": "face_with_steam_from_nose",
    "😩": "weary_face",
    "😬": "grimacing_face",
    "😱": "face_screaming_in_fear",
    "😳": "flushed_face",
    "😴": "sleeping_face",
    "🙁": "slightly_frowning_face",
    "🙃": "upside-down_face",
    "🙄": "face_with_rolling_eyes",
    "🙈": "see-no-evil_monkey",
    "🚀": "rocket",
    "🚨": "police_car_light",
    "🤖": "robot",
    "🤗": "smiling_face_with_open_hands",
    "🤝": "handshake",
    "🤦": "person_facepalming",
    "🤷": "person_shrugging",
    "🥰": "smiling_face_with_hearts",
    "🧠": "brain",
}

JOINER, PRESENTATION, KEYCAP = "\u200d", "\ufe0f", "\u20e3"
#: Skin tones, hair, and the persons and objects that joined sequences are made of. Fixed values.
TONES = dict(zip("🏻🏼🏽🏾🏿", ("light", "medium-light", "medium", "medium-dark", "dark")))
HAIR = {"🦰": "red_hair", "🦱": "curly_hair", "🦳": "white_hair", "🦲": "bald"}
PERSONS = {"👨": "man", "👩": "woman", "🧑": "person"}
CHILDREN = {"👦": "boy", "👧": "girl"}
SIGNS = {"♀": "woman", "♂": "man"}
JOBS = {
    "⚕": "health_worker", "⚖": "judge", "✈": "pilot", "🌾": "farmer", "🍳": "cook", "🍼": "feeding_baby", "🎓": "student",
    "🎤": "singer", "🎨": "artist", "🏫": "teacher", "🏭": "factory_worker", "💻": "technologist", "💼": "office_worker",
    "🔧": "mechanic", "🔬": "scientist", "🚀": "astronaut", "🚒": "firefighter", "🦯": "with_white_cane",
    "🦼": "in_motorized_wheelchair", "🦽": "in_manual_wheelchair",
}
JOINED = {
    "🏳‍🌈": "rainbow_flag", "🏳‍⚧": "transgender_flag", "🏴‍☠": "pirate_flag", "👁‍🗨": "eye_in_speech_bubble", "🐕‍🦺": "service_dog",
    "🐈‍⬛": "black_cat", "🐻‍❄": "polar_bear", "🐦‍⬛": "black_bird", "❤‍🔥": "heart_on_fire", "❤‍🩹": "mending_heart",
    "😮‍💨": "face_exhaling", "😵‍💫": "face_with_spiral_eyes", "😶‍🌫": "face_in_clouds",
}
#: Persons that a sign of gender may follow, with the name that follows "woman" or "man". Fixed values.
GENDERED = {
    "🏃": "running", "🏄": "surfing", "🏊": "swimming", "🏋": "lifting_weights", "🏌": "golfing", "⛹": "bouncing_ball", "👮": "police_officer",
    "👰": "with_veil", "👱": "blond_hair", "👳": "wearing_turban", "👷": "construction_worker", "💁": "tipping_hand", "💂": "guard",
    "💆": "getting_massage", "💇": "getting_haircut", "🕵": "detective", "🙅": "gesturing_NO", "🙆": "gesturing_OK", "🙇": "bowing",
    "🙋": "raising_hand", "🙍": "frowning", "🙎": "pouting", "🚣": "rowing_boat", "🚴": "biking", "🚵": "mountain_biking", "🚶": "walking",
    "🤦": "facepalming", "🤵": "in_tuxedo", "🤷": "shrugging", "🤸": "cartwheeling", "🤹": "juggling", "🤽": "playing_water_polo",
    "🤾": "playing_handball", "🦸": "superhero", "🦹": "supervillain", "🧍": "standing", "🧎": "kneeling", "🧏": "deaf", "🧔": "beard",
    "🧖": "in_steamy_room", "🧗": "climbing", "🧘": "in_lotus_position", "🧙": "mage", "🧚": "fairy", "🧛": "vampire", "🧜": "merperson",
    "🧝": "elf", "🧞": "genie", "🧟": "zombie",
}
#: Hands that take a skin tone, beside persons. Fixed values.
TONED = "☝✊✋✌✍👂👃👆👇👈👉👊👋👌👍👎👏👐👼👶💃💅💪🕴🕺🖐🖕🖖🙌🙏🛀🛌🤌🤏🤘🤙🤚🤛🤜🤝🤞🤟🤰🤱🤲🤳🦵🦶🦻🧒🧓👴👵🧕👲🤴👸🎅🤶🫰🫱🫲🫳🫴🫵🫶🏂🏇"

#: One comparison a character rules most texts out: no emoji and no keycap is without one of these.
MAYBE_EMOJI = "[\\x{A9}\\x{AE}\\x{203C}-\\x{10FFFF}]"
EMOJI_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in RANGES) + "]"
_TONE, _FLAG = "[\\x{1F3FB}-\\x{1F3FF}]", "[\\x{1F1E6}-\\x{1F1FF}]"
_ONE = f"{EMOJI_CLASS}\\x{{FE0F}}?{_TONE}?"
#: The longest sequence that shows as one emoji, or else one character.
TOKEN = f"(?s)({_FLAG}{_FLAG}|[0-9#*]\\x{{FE0F}}?\\x{{20E3}}|{_ONE}(?:\\x{{200D}}{_ONE})*|.)"


@cache
def single_names() -> dict[str, str]:
    """Emoji of one character -> its name."""
    found = {}
    for a, b in RANGES:
        for point in range(a, b + 1):
            char = chr(point)
            name = OTHER_NAMES.get(char) or unicodedata.name(char, "").lower().replace(" ", "_")
            if name:
                found[char] = name
    found |= {tone: f"{name}_skin_tone" for tone, name in TONES.items()} | PERSONS | CHILDREN
    return found


@cache
def rule_names() -> dict[str, str]:
    """Emoji -> its name: single ones and sequences, without presentation selectors."""
    found, letters = dict(single_names()), [chr(0x1F1E6 + k) for k in range(26)]
    region = lambda x: chr(ord(x) - 0x1F1E6 + ord("A"))
    found |= {a + b: f"flag_{region(a)}{region(b)}" for a in letters for b in letters}
    found |= {k + KEYCAP: f"keycap_{k}" for k in "0123456789#*"} | JOINED
    for tone, shade in {"": "", **{t: f"_{n}_skin_tone" for t, n in TONES.items()}}.items():
        found |= {c + tone: found[c] + shade for c in [*TONED, *PERSONS, *CHILDREN, *GENDERED] if c in found}
        for person, name in PERSONS.items():
            found |= {person + tone + JOINER + sign: f"{name}_{job}{shade}" for sign, job in JOBS.items()}
            cut = lambda hair: f"{name}_{shade[1:]}_{hair}" if shade else f"{name}_{hair}"  # noqa: B023, E731
            found |= {person + tone + JOINER + sign: cut(hair) for sign, hair in HAIR.items()}
        for person, doing in GENDERED.items():
            found |= {person + tone + JOINER + sign: f"{name}_{doing}{shade}" for sign, name in SIGNS.items()}
    adults, young = {k: v for k, v in PERSONS.items() if v != "person"}, [(), *[(c,) for c in CHILDREN], ("👧", "👦"), ("👦", "👦"), ("👧", "👧")]
    for group in [(a,) for a in adults] + [("👨", "👨"), ("👨", "👩"), ("👩", "👩")]:
        for kids in young:
            if kids:
                found[JOINER.join([*group, *kids])] = "_".join(["family", *[PERSONS[a] for a in group], *[CHILDREN[c] for c in kids]])
    for pair in [("👨", "👨"), ("👩", "👨"), ("👩", "👩")]:
        who = "_".join(PERSONS[a] for a in pair)
        found[JOINER.join([pair[0], "❤", pair[1]])] = f"couple_with_heart_{who}"
        found[JOINER.join([pair[0], "❤", "💋", pair[1]])] = f"kiss_{who}"
    return found


def emoji_names(more: Mapping[str, str] | None = None) -> dict[str, str]:
    """Emoji -> its name between colons; ``more`` has names that go before those by rule."""
    given = {k.replace(PRESENTATION, ""): v for k, v in (more or {}).items()}
    return {k: f":{v}:" for k, v in (rule_names() | given).items()}
