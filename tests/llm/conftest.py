from hypothesis import settings

settings.register_profile("llm", deadline=None, derandomize=True)
settings.load_profile("llm")
