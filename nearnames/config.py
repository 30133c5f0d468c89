"""Settings with their defaults, and fixed word lists."""

from __future__ import annotations

from dataclasses import dataclass

POSITIVE, UNLABELED, REJECTED = 1, 0, -1

# Words that are skipped when a core word is looked for.
STOPWORDS = """
acetate bromide carbonate chloride citrate dihydrate dihydrochloride dipropionate fumarate gluconate hcl hydrobromide
hydrochloride hydroxide maleate monohydrate mononitrate phosphate potassium propionate sodium succinate sulfate sulphate
trihydrate valerate besilate
adsorbed cap capsule capsules cream drops er eye formulation gel iv mg mr odt ointment reformulated solution sr
suspension syrup tab tablet tablets topical xr
advance and ds for forte kids od plus with
""".split()

# First words that say little alone, so that the next word is kept too.
LEADING_WORDS = """
bio co dr fin go md mega neo neuro new one rapid st tri
calcium human insulin iron magnesium multivitamins potassium purified sodium tetanus vitamin zinc
""".split()

# Words that cannot complete a leading word.
LEADING_EXCLUDED = """
adsorbed advance and cap capsule capsules cream drops ds er eye for formulation forte gel iv kids mg mr od odt ointment
plus reformulated solution sr suspension syrup tab tablet tablets topical with xr
""".split()

#: Column names of the engineered features, in order.
ENGINEERED = (
    "len_diff", "common_prefix_len", "common_suffix_len", "fil_onset_match", "fil_coda_match", "fil_vowel_skeleton_match",
    "fil_penult_vowel_match", "fil_phonetic_equal", "n_marked", "english_prominence_match", "syllable_count_diff", "syllable_diff",
    "vowel_count_diff", "consonant_count_diff",
)

#: Scores of core words: eight of spelling, one of sound.
CORE_SCORES = ("bisim", "editex", "lcsubstring", "lcsuf", "levenshtein", "levenshtein_consonant", "prefix", "visual_weighted", "aline_cangu")


@dataclass(frozen=True)
class Config:
    positive_prevalence: float = 1 / 451
    tier_1_proportion: float = 0.65
    tier_2_proportion: float = 0.35
    tier_2_sample_size: int = 10_000
    tier_2_max_pool: int = 300
    oversample_factor: int = 4
    min_pool: int = 50
    similarity_threshold: float = 65.0
    noise_oversample: int = 2
    random_share: float = 0.1
    skip_variants: bool = True
    seed: int = 42
    shuffle_seed: int = 67
    candidate_limit: int = 20
    min_edit: int = 1
    min_length_ratio: float = 0.5
    ratio_threshold: float = 50.0
    soundex_threshold: float = 0.75
    min_hardness: float = 0.4
    max_hardness: float = 0.8
    hardness_oversample: int = 5
    min_registry_rows: int = 500

    def check(self) -> Config:
        if not 0 < self.positive_prevalence < 1:
            raise ValueError(f"positive_prevalence must be in (0, 1), not {self.positive_prevalence}")
        if abs(self.tier_1_proportion + self.tier_2_proportion - 1) > 1e-6:
            raise ValueError("tier_1_proportion and tier_2_proportion must add up to 1")
        return self
