from cwlight.llm import secrets


def values(text):
    return [text[a:b] for a, b, _ in secrets.guessed_spans(text)]


def test_joined_names_are_credential_context():
    value = "x7Gq!9zLp0Rt"
    for name in ("AWS_SECRET_ACCESS_KEY", "DB_PWD", "rsa_private_key", "my-api-key", "dbPwd", "rsaPrivateKey", "pwd"):
        assert values(f"{name}={value}") == [value] and values(f"{name}: {value}") == [value], name
    for name in ("compass", "spinpin", "bypass", "2pass"):
        assert values(f"{name}: {value}") == [], name


def test_letters_only_are_judged_by_their_cost():
    for value in ("qzkfjxwvbnmplkjhgfdsq", "XkQvZpWjTrGbMwHq", "correcthorsebatterystaple"):
        assert values(f"pwd: {value} end") == [value]
    for value in ("authentication", "Internationalization", "Authentifizierung", "développement", "contraseña", "Schlüsselwort", "認証トークンの設定", "required"):
        assert values(f"token: {value} end") == [], value
