import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohort.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "7", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(autouse=True)
def _drop_kept_tables(spark):
    yield
    spark.catalog.clearCache()


@pytest.fixture
def survey(spark):
    """The default survey layout: 72 rows made by row index, one null."""
    sleep = ["Less than 5 hours", "5-6 hours", "7-8 hours", "More than 8 hours"]
    diet, degree = ["Healthy", "Moderate", "Unhealthy"], ["BSc", "BA", "MSc"]
    rows = []
    for i in range(72):
        positive = int(i % 4 in (1, 2, 3))
        rows.append((
            i + 1, "Male" if i % 2 == 0 else "Female", 18 + i % 10, f"City-{i % 4}", "Student", 2 + i % 3 + positive, 0, 6.2 + (i % 5) * 0.4,
            4 - i % 3, 0, sleep[i % 4], diet[i % 3], degree[i % 3], "No" if i % 5 == 0 else "Yes", 3 + i % 6,
            None if i == 2 else 1 + i % 4 + positive, "Yes" if i % 3 == 0 else "No", positive))
    names = ["id", "Gender", "Age", "City", "Profession", "Academic Pressure", "Work Pressure", "CGPA", "Study Satisfaction", "Job Satisfaction",
             "Sleep Duration", "Dietary Habits", "Degree", "Have you ever had suicidal thoughts ?", "Work/Study Hours", "Financial Stress",
             "Family History of Mental Illness", "Depression"]
    kinds = "long string long string string long long double long long string string string string long long string int".split()
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds)))
