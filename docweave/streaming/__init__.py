"""Order-dependent state: rate limiter, response cache, conversation threads."""
