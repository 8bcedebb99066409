import shutil
import tempfile

import pytest

from plumbline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    path = tempfile.mkdtemp(prefix="plumbline-test-")
    yield path
    shutil.rmtree(path, ignore_errors=True)
