"""Column roles of the default survey table; every operator takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

# Names, maps and bands of the default survey layout.
TARGET = "Depression"
SENSITIVE = "Have you ever had suicidal thoughts ?"
EXCLUDED = ["id", "Profession", "Work Pressure", "Job Satisfaction"]
NUMERIC = ["Age", "CGPA", "Work/Study Hours"]
ORDINAL = ["Academic Pressure", "Study Satisfaction", "Financial Stress"]
NOMINAL = ["Gender", "City", "Degree", "Sleep Duration", "Dietary Habits", "Family History of Mental Illness"]
AGE_BANDS = [("18-22", 18, 22), ("23-26", 23, 26), ("27-30", 27, 30), ("31+", 31, 120)]
SEVERITY = [(4, "Không trầm cảm"), (9, "Nhẹ"), (14, "Trung bình"), (19, "Khá nặng")]
SEVERITY_LAST = "Nặng"
AT_RISK_SCORE = 16
CRITICAL = ["depression_score", "age", "gender"]
RENAMES = {
    "id": "id",
    "Gender": "gioi_tinh",
    "Age": "tuoi",
    "City": "thanh_pho",
    "Profession": "nghe_nghiep",
    "Academic Pressure": "ap_luc_hoc_tap",
    "Work Pressure": "ap_luc_cong_viec",
    "CGPA": "cgpa",
    "Study Satisfaction": "hai_long_hoc_tap",
    "Job Satisfaction": "hai_long_cong_viec",
    "Sleep Duration": "thoi_gian_ngu",
    "Dietary Habits": "che_do_an",
    "Degree": "nganh_hoc",
    "Have you ever had suicidal thoughts ?": "y_nghi_tu_tu",
    "Work/Study Hours": "gio_lam_hoc",
    "Financial Stress": "ap_luc_tai_chinh",
    "Family History of Mental Illness": "tien_su_benh_tm",
    "Depression": "tram_cam",
}
RECODES = {
    "gioi_tinh": {"Male": "Nam", "Female": "Nu"},
    "thoi_gian_ngu": {
        "Less than 5 hours": "Duoi_5h",
        "5-6 hours": "5_6h",
        "7-8 hours": "7_8h",
        "More than 8 hours": "Tren_8h",
        "Others": "Khac",
    },
    "che_do_an": {
        "Unhealthy": "Khong_lanh_manh",
        "Moderate": "Trung_binh",
        "Healthy": "Lanh_manh",
        "Others": "Khac",
    },
    "y_nghi_tu_tu": {"Yes": "Co", "No": "Khong"},
    "tien_su_benh_tm": {"Yes": "Co", "No": "Khong"},
}
STANDARD_ORDINAL = [
    "thoi_gian_ngu", "che_do_an", "ap_luc_hoc_tap", "ap_luc_cong_viec",
    "hai_long_hoc_tap", "hai_long_cong_viec", "ap_luc_tai_chinh",
]
STANDARD_NOMINAL = ["gioi_tinh", "thanh_pho", "nghe_nghiep", "nganh_hoc", "y_nghi_tu_tu", "tien_su_benh_tm"]
STANDARD_NUMERIC = ["tuoi", "cgpa", "gio_lam_hoc"]


@dataclass(frozen=True)
class ColumnRoles:
    target: str = TARGET
    row_id: str = "id"
    numeric: list[str] = field(default_factory=lambda: list(NUMERIC))
    ordinal: list[str] = field(default_factory=lambda: list(ORDINAL))
    nominal: list[str] = field(default_factory=lambda: list(NOMINAL))
    sensitive: str | None = SENSITIVE
    excluded: list[str] = field(default_factory=lambda: list(EXCLUDED))

    def features(self, profile: str = "full") -> list[str]:
        """Model columns; ``safe`` leaves the sensitive column out."""
        if profile not in ("safe", "full"):
            raise ValueError(f"unknown profile {profile!r}")
        sensitive = [self.sensitive] if profile == "full" and self.sensitive else []
        return [*self.numeric, *self.ordinal, *self.nominal, *sensitive]

    def for_profile(self, profile: str) -> "ColumnRoles":
        """Roles of one profile, the sensitive column counted among the nominal ones."""
        extra = [self.sensitive] if profile == "full" and self.sensitive else []
        return replace(self, nominal=[*self.nominal, *extra], sensitive=None)

    def present(self, df: DataFrame) -> "ColumnRoles":
        keep = lambda names: [n for n in names if n in df.columns]
        return replace(
            self, numeric=keep(self.numeric), ordinal=keep(self.ordinal), nominal=keep(self.nominal),
            sensitive=self.sensitive if self.sensitive in df.columns else None, excluded=keep(self.excluded),
        )


STANDARD_ROLES = ColumnRoles(
    target="tram_cam", row_id="id", numeric=STANDARD_NUMERIC, ordinal=STANDARD_ORDINAL,
    nominal=STANDARD_NOMINAL, sensitive=None, excluded=[],
)
