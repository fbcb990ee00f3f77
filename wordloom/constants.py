"""Strings and tables that results must carry literally."""

import string

# Characters deleted by remove_punctuation and remove_special_chars.
PUNCTUATION = string.punctuation
SPECIAL_CHARS = "#$@{}[]/\\)(<>|!'^+%&½=*€~¨´æ£éß"

# Texts put in place of a result that could not be computed.
CLEANING_ERROR = "Text cleaning error"
DETECTION_ERROR = "Language detection error"
PREDICTION_ERROR = "Tahmin Hatası"
NO_PREDICTION = "Tahmin yapılamadı"
UNSUPPORTED_LANGUAGE = "Dil desteklenmiyor"
UNKNOWN_CLASS = "Bilinmeyen Sınıf"

# Messages of the single-text job.
ENTER_TEXT = "Lütfen metin girin."
CHOOSE_OPERATION = "Lütfen en az bir işlem türü veya sınıflandırma seçin."
DETECTION_FAILED = "Dil tespiti sırasında bir hata oluştu."
CLEANING_FAILED = "Metin temizleme sırasında bir hata oluştu."
LANGUAGE_NOT_SUPPORTED = 'Girdiğiniz metnin dili "%s", modeller tarafından desteklenmiyor.'

# Class ids and names of the two built-in models.
LABEL_MAPS = {
    "en": {
        1: "World",
        2: "Sports",
        3: "Business",
        4: "Sci/Tech",
        5: "Entertainment",
        6: "Politics",
    },
    "tr": {
        0: "Ekonomi",
        1: "Kültür-Sanat",
        2: "Sağlık",
        3: "Siyaset",
        4: "Spor",
        5: "Teknoloji",
    },
}

# Languages the built-in models cover.
SUPPORTED = ("en", "tr")
