"""Fixed values.

Word lists, tables and constants whose exact content decides the results.
They are kept together, as plain text, in their natural order.
"""

from __future__ import annotations

# --- fixed values: vector weights -------------------------------------------
TAG_PROMPT_WEIGHTS = [0.52, 0.28, 0.20]
ENSEMBLE_PROMPTS = {
    "semantic_scene_prompt": 0.25,
    "music_for_scene_prompt": 0.20,
    "emotion_prompt": 0.15,
    "narrative_prompt": 0.15,
    "sonic_prompt": 0.10,
    "tag_prompt": 0.10,
    "concise_core_prompt": 0.05,
}
HYBRID_WEIGHTS = {"main": 0.45, "tags": 0.20, "clap_ensemble": 0.35}
VECTOR_DIM = 512

# --- fixed values: score weights --------------------------------------------
SCORE_WEIGHTS = {
    "final": {"embedding": 0.40, "semantic": 0.25, "targets": 0.20, "tag_selection": 0.15},
    "embedding": {"main": 0.15, "tags": 0.10, "ensemble": 0.20, "hybrid": 0.50, "audio_aux": 0.05},
    "semantic": {"emotion": 0.35, "narrative": 0.25, "weight_profile": 0.20, "dialogue": 0.20},
    "targets": {
        "energy": 0.20,
        "tempo": 0.20,
        "rhythm": 0.15,
        "intensity_shape": 0.20,
        "sound_character": 0.25,
    },
    "tag_selection": {"should_have": 0.75, "must_not": 0.25},
}

# --- fixed values: ordered scales -------------------------------------------
ENERGY_SCALE = ["very_low", "low", "medium", "high", "very_high"]
TEMPO_SCALE = ["very_slow", "slow", "moderate", "fast", "very_fast"]
INTENSITY_SCALE = [
    "static", "gradual_build", "crescendo", "peak", "climax_peak",
    "drop", "release", "wave", "pulsating",
]
ORDINAL_STEP = 0.25

# --- fixed values: penalties ------------------------------------------------
DIALOGUE_PENALTY_STRICT = 0.20
DIALOGUE_PENALTY_LAX = 0.10
DURATION_PENALTY_NONE = 0.10     # no positive duration
DURATION_PENALTY_30 = 0.15       # shorter than 30 s
DURATION_PENALTY_60 = 0.05       # shorter than 60 s
FORBIDDEN_STEP = 0.08
FORBIDDEN_MAX = 0.25
STYLE_STEP = 0.10
SAME_TRACK_PENALTY = 0.12
MISSING_STEP = 0.02
MISSING_MIN = 0.05
MISSING_MAX = 0.25

# --- fixed values: low-confidence view --------------------------------------
LOW_FINAL = 0.45
LOW_SEMANTIC = 0.40
LOW_TARGETS = 0.40
HIGH_PENALTY = 0.25

# --- fixed values: tag selection rules --------------------------------------
# category: (top_k, threshold, margin, required)
CATEGORY_RULES = {
    "emotion": (3, 0.255, 0.020, 0),
    "scene": (2, 0.245, 0.020, 0),
    "energy": (1, 0.215, 0.015, 1),
    "tempo": (1, 0.215, 0.015, 1),
    "rhythm": (1, 0.215, 0.015, 1),
    "intensity_shape": (1, 0.220, 0.015, 1),
    "narrative": (3, 0.235, 0.018, 1),
    "sound_character": (3, 0.230, 0.018, 1),
    "usage": (2, 0.225, 0.018, 0),
    "instrumentation": (3, 0.225, 0.018, 0),
    "atmosphere": (2, 0.225, 0.018, 0),
    "special": (2, 0.225, 0.018, 0),
}
DEFAULT_RULE = (1, 0.22, 0.015, 0)
SURE_BONUS = 0.035      # kept without margin when this far above the threshold
FALLBACK_SLACK = 0.020  # best tag of a required category may be this far below

# --- fixed values: profile hints --------------------------------------------
PROFILE_HINTS = {
    "dialogue": ["dialogue", "conversation", "background_music", "underscore",
                 "dialogue_safe", "restrained", "sparse", "intimate"],
    "investigation": ["investigation", "mystery", "curiosity", "tension",
                      "suspense", "textured", "pulsating"],
    "action": ["action", "danger", "aggression", "driving", "fast",
               "very_fast", "high", "very_high", "hits", "impacts", "pulses"],
    "dramatic_scene": ["dramatic_scene", "sadness", "grief", "melancholy",
                       "hope", "emotional_support", "strings", "piano"],
    "horror_scene": ["horror_scene", "fear", "suspense", "dark",
                     "eerie", "tension_building", "textured"],
    "thriller_scene": ["thriller_scene", "tension", "suspense", "anxiety",
                       "investigation", "driving", "pulsating"],
    "romantic_scene": ["romantic_scene", "love", "romance", "warmth", "intimate", "sparse"],
    "comedic_scene": ["comedic_scene", "playful", "joy", "happiness"],
    "transition": ["transition", "bridge", "release", "background", "underscore", "moderate"],
    "montage": ["montage", "determination", "hope", "uplifting", "driving", "gradual_build"],
    "climax": ["climax", "climax_peak", "epic", "heroism",
               "very_high", "hits", "impacts", "trailer_music"],
    "resolution": ["resolution", "relief", "peace", "release", "warm", "calm"],
    "aftermath": ["aftermath", "grief", "sadness", "calm", "peace",
                  "sparse", "very_slow", "slow"],
}
PROFILE_MIN = 0.24
PROFILE_WINDOW = 0.12
PROFILE_DIALOGUE_SHARE = 0.45

# --- fixed values: contrary tags --------------------------------------------
CONTRARY_TAGS = {
    "very_low": ["very_high", "high"],
    "low": ["very_high"],
    "high": ["very_low", "dialogue_safe"],
    "very_high": ["very_low", "low", "dialogue_safe", "restrained"],
    "very_slow": ["very_fast", "fast"],
    "slow": ["very_fast"],
    "fast": ["very_slow", "dialogue_safe"],
    "very_fast": ["very_slow", "slow"],
    "dialogue_safe": ["hits", "impacts", "very_high", "climax_peak", "trailer_music"],
    "restrained": ["hits", "impacts", "very_high", "climax_peak", "trailer_music"],
    "background_music": ["hits", "impacts"],
    "trailer_music": ["dialogue_safe", "restrained", "very_low", "very_slow"],
    "dark": ["warm", "uplifting", "playful"],
    "uplifting": ["dark", "eerie", "fear"],
    "playful": ["dark", "suspense", "fear", "grief"],
    "joy": ["fear", "grief", "melancholy"],
    "fear": ["joy", "relief", "peace"],
    "peace": ["aggression", "danger", "very_high"],
    "intimate": ["wide"],
    "wide": ["intimate"],
    "sparse": ["dense"],
    "dense": ["sparse"],
    "clean": ["distorted", "noisy"],
    "distorted": ["clean"],
    "analog": ["digital"],
    "digital": ["analog"],
}

# --- fixed values: dialogue-safe coefficients -------------------------------
DIALOGUE_SAFE_BASE = 0.50
DIALOGUE_SAFE = {
    "dialogue_safe": 0.45, "restrained": 0.28, "background_music": 0.24, "underscore": 0.22,
    "sparse": 0.18, "intimate": 0.16, "low": 0.14, "very_low": 0.10,
}
DIALOGUE_RISK = {
    "hits": 0.34, "impacts": 0.34, "trailer_music": 0.25, "climax_peak": 0.21,
    "very_high": 0.18, "peak": 0.14, "dense": 0.10,
}
DIALOGUE_FLAG_AT = 0.60
DIALOGUE_STRONG_AT = 0.62

# --- fixed values: must-not rules -------------------------------------------
LOUD_TAGS = ["hits", "impacts", "trailer_music", "very_high", "climax_peak"]
LOUD_BASE, LOUD_SHARE = 0.50, 0.30
PROFILE_BANS = {
    "dialogue": ["hits", "impacts", "trailer_music", "very_high"],
    "action": ["dialogue_safe", "restrained", "very_low"],
}
PROFILE_BAN_SCORE = 0.42
CONTRARY_MIN = 0.20
TARGET_BAN_SCORE = 0.30

# --- fixed values: signal hints ---------------------------------------------
TEMPO_BOUNDS = [(55, "very_slow"), (80, "slow"), (118, "moderate"), (145, "fast")]
ENERGY_BOUNDS = [(0.030, "very_low"), (0.060, "low"), (0.110, "medium"), (0.180, "high")]
RHYTHM_BOUNDS = [(0.035, "floating"), (0.070, "steady"), (0.110, "syncopated")]
SOUND_BOUNDS = [(1600, ["intimate", "analog"]), (3200, ["atmospheric", "textured"])]
SOUND_ABOVE = ["clean", "wide"]
DRIVING_BPM = 120
PEAK_RMS = 0.14
PULSE_CROSSINGS = 0.09
BUILD_RMS = 0.08
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
AUDIO_SUFFIXES = [".wav", ".mp3", ".flac", ".ogg", ".m4a"]

# --- fixed values: texts ----------------------------------------------------
TAG_PROMPT_TEMPLATES = [
    "cinematic instrumental music with {tag}",
    "music tagged as {category}: {tag}",
    "film underscore with {tag}",
]
SCENE_HEADER = r"^\s*SCENA\s+(\d+)\s*[\.\:\-]?\s*(.*)$"
PROMPT_MAX = 120
TEXT_MAX = 240

# --- fixed values: tag taxonomy ---------------------------------------------
TAXONOMY = {
    "emotion": {"category_pl": "emocja", "tags": {
        "tension": "napięcie", "suspense": "suspens", "fear": "strach",
        "anxiety": "niepokój", "danger": "zagrożenie", "sadness": "smutek",
        "grief": "żal", "melancholy": "melancholia", "loneliness": "samotność",
        "nostalgia": "nostalgia", "joy": "radość", "happiness": "szczęście",
        "hope": "nadzieja", "relief": "ulga", "love": "miłość",
        "romance": "romantyzm", "warmth": "ciepło emocjonalne", "anger": "gniew",
        "aggression": "agresja", "determination": "determinacja", "courage": "odwaga",
        "triumph": "triumf", "epic": "epickość", "heroism": "heroizm",
        "mystery": "tajemnica", "curiosity": "ciekawość", "wonder": "zachwyt",
        "awe": "podziw", "serenity": "pogoda ducha", "calm": "spokój",
        "peace": "pokój", "spirituality": "duchowość"}},
    "scene": {"category_pl": "scena", "tags": {
        "dialogue": "dialog", "conversation": "rozmowa", "transition": "przejście",
        "montage": "montaż", "investigation": "śledztwo", "action": "akcja",
        "climax": "kulminacja", "resolution": "rozwiązanie", "aftermath": "następstwa",
        "horror_scene": "scena horroru", "thriller_scene": "scena thrillera",
        "romantic_scene": "scena romantyczna", "dramatic_scene": "scena dramatyczna",
        "comedic_scene": "scena komediowa"}},
    "energy": {"category_pl": "energia", "tags": {
        "very_low": "bardzo niska", "low": "niska", "medium": "średnia",
        "high": "wysoka", "very_high": "bardzo wysoka"}},
    "tempo": {"category_pl": "tempo", "tags": {
        "very_slow": "bardzo wolne", "slow": "wolne", "moderate": "umiarkowane",
        "fast": "szybkie", "very_fast": "bardzo szybkie"}},
    "rhythm": {"category_pl": "rytm", "tags": {
        "steady": "równy", "syncopated": "synkopowany", "irregular": "nieregularny",
        "driving": "napędzający", "floating": "płynący", "free": "swobodny"}},
    "intensity_shape": {"category_pl": "kształt intensywności", "tags": {
        "static": "stała", "gradual_build": "stopniowy wzrost", "crescendo": "crescendo",
        "peak": "szczyt", "climax_peak": "szczyt kulminacyjny", "drop": "spadek",
        "release": "rozładowanie", "wave": "falowanie", "pulsating": "pulsowanie"}},
    "narrative": {"category_pl": "funkcja narracyjna", "tags": {
        "background": "tło", "foreground": "pierwszy plan",
        "underscore": "podkład narracyjny", "emotional_support": "wsparcie emocjonalne",
        "tension_building": "budowanie napięcia", "suspense_building": "budowanie suspensu",
        "anticipation": "oczekiwanie", "release": "rozładowanie",
        "payoff": "punkt kulminacyjny narracji", "transition": "przejście",
        "bridge": "most", "accent": "akcent", "stinger": "nagły akcent",
        "climax_support": "wsparcie kulminacji"}},
    "sound_character": {"category_pl": "charakter dźwięku", "tags": {
        "atmospheric": "atmosferyczny", "textured": "teksturalny", "dense": "gęsty",
        "sparse": "rzadki", "wide": "szeroki", "intimate": "intymny",
        "distorted": "zniekształcony", "clean": "czysty", "noisy": "szumowy",
        "glitchy": "glitchowy", "analog": "analogowy", "digital": "cyfrowy"}},
    "usage": {"category_pl": "zastosowanie", "tags": {
        "background_music": "muzyka tła", "film_score": "muzyka filmowa",
        "trailer_music": "muzyka trailerowa"}},
    "instrumentation": {"category_pl": "instrumentarium", "tags": {
        "hits": "uderzenia orkiestrowe", "impacts": "uderzenia efektowe",
        "pulses": "pulsacje", "drums": "perkusja", "strings": "smyczki",
        "piano": "fortepian", "synth": "syntezator", "guitar": "gitara",
        "choir": "chór", "pads": "pady"}},
    "atmosphere": {"category_pl": "atmosfera", "tags": {
        "dark": "mroczna", "eerie": "niepokojąca", "warm": "ciepła",
        "uplifting": "podnosząca", "emotional": "emocjonalna", "serious": "poważna",
        "playful": "figlarna", "intimate": "intymna", "expansive": "rozległa"}},
    "special": {"category_pl": "tagi specjalne", "tags": {
        "dialogue_safe": "bezpieczny pod dialog", "restrained": "powściągliwy",
        "cinematic": "filmowy"}},
}

# --- fixed values: allowed values of scene answers --------------------------
# Scene answers use the taxonomy words, with one other word in the narrative list.
ANSWER_NARRATIVE_SWAP = {"release": "narrative_release"}
