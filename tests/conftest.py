import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from msgsieve.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    return DATA


@pytest.fixture(scope="session")
def sample(spark):
    """Two labelled messages per class."""
    rows = [
        ("m1", "เย็นนี้กินข้าวบ้านแม่นะ ซื้อผลไม้มาด้วย", 0),
        ("m2", "ด่วน! รับคูปอง 12,500 บาท ฟรีวันนี้ ลงทะเบียนที่ www.coupon-demo.example/join", 1),
        ("m3", "บัญชีของคุณถูกระงับ กรุณายืนยันรหัส 778899 ที่ http://verify-demo.example ภายใน 10 นาที", 2),
        ("m4", "ประชุมเลื่อนเป็นพรุ่งนี้เก้าโมง เจอกันที่ห้องเดิม", 0),
        ("m5", "สินค้าลดราคา 60% ถึงเที่ยงคืน!! โทร 081-234-5678", 1),
        ("m6", "พัสดุของท่านติดด่านศุลกากร ชำระค่าธรรมเนียม โทร 089-876-5432", 2),
    ]
    names = ["ham", "spam", "phishing"]
    full = [(i, t, l, names[l], "synthetic", "2024-01-01 10:00:00") for i, t, l in rows]
    return spark.createDataFrame(
        full, "message_id string, text string, label int, label_name string, source string, created_at string"
    )
