import pytest


@pytest.fixture(scope="session")
def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path
