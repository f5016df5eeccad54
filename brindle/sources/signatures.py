"""Catalogue of credential signatures.

`\\b` stands for an ASCII word boundary in every pattern; `java_pattern` spells it out for
Java's regex engine, where `\\b` also looks at other letters. Users may append rows of their own.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Findings of these are public by design; the example token is a placeholder.
PUBLIC = ("Sentry DSN", "Stripe publishable key", "Supabase publishable key")
PLACEHOLDER = ("Facebook example token",)

# Fixed values: (name, environment variable, pattern), in catalogue order; the first match wins.
SIGNATURES = (
    ("Adafruit IO key", "ADAFRUIT_IO_KEY", r"\baio_[a-zA-Z0-9]{28}\b"),
    ("Adyen API key", "ADYEN_API_KEY", r"\bAQE[A-Za-z0-9]{170,}\b"),
    ("Age secret key", "AGE_SECRET_KEY", r"AGE-SECRET-KEY-1[a-z0-9]{58}"),
    ("Alchemy API key", "ALCHEMY_API_KEY", r"\balcht_[a-zA-Z0-9]{30}\b"),
    ("Alibaba Cloud access key ID", "ALIBABA_CLOUD_ACCESS_KEY_ID", r"\bLTAI[A-Za-z0-9]{12,20}\b"),
    ("Amazon MWS auth token", "AMAZON_MWS_AUTH_TOKEN", r"\bamzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    ("Apify API token", "APIFY_API_TOKEN", r"\bapify_api_[A-Za-z0-9]{20,}\b"),
    ("Anthropic API key", "ANTHROPIC_API_KEY", r"\bsk-ant-(?:api03|admin01)-[A-Za-z0-9_\-]{93}AA\b"),
    ("Apache apr1 password hash", "APR1_PASSWORD_HASH", r"\$apr1\$[A-Za-z0-9./]{1,8}\$[A-Za-z0-9./]{22}"),
    ("Argon2 password hash", "ARGON2_PASSWORD_HASH", r"\$argon2(?:id|i|d)\$(?:v=[0-9]+\$)?m=[0-9]+,t=[0-9]+,p=[0-9]+\$[A-Za-z0-9+/]+\$[A-Za-z0-9+/]+"),
    ("Artifactory token", "ARTIFACTORY_TOKEN", r"\b(?:AKCp[A-Za-z0-9]{69}|cmVmd[A-Za-z0-9]{59})\b"),
    ("Atlassian API token", "ATLASSIAN_API_TOKEN", r"\bATATT3[A-Za-z0-9_\-=]{100,}\b"),
    ("Authress service client access key", "AUTHRESS_ACCESS_KEY", r"\b(?:sc|ext|scauth|authress)_[A-Za-z0-9]{5,30}\.[A-Za-z0-9]{4,6}\.acc[_\-][A-Za-z0-9\-]{10,32}\.[A-Za-z0-9+/_=\-]{30,120}"),
    ("AWS access key", "AWS_ACCESS_KEY_ID", r"\b(?:AKIA|ABIA|ACCA|A3T[A-Z0-9])[A-Z0-9]{16}\b"),
    ("AWS temporary access key", "AWS_ACCESS_KEY_ID", r"\bASIA[A-Z0-9]{16}\b"),
    ("AWS Bedrock API key", "AWS_BEARER_TOKEN_BEDROCK", r"\bABSK[A-Za-z0-9+/]{109,}={0,2}"),
    ("bcrypt password hash", "BCRYPT_PASSWORD_HASH", r"\$2[abxy]\$[0-9]{2}\$[A-Za-z0-9./]{53}"),
    ("Bitbucket app password", "BITBUCKET_APP_PASSWORD", r"\bATBB[A-Za-z0-9_=.\-]{20,}\b"),
    ("Axiom API token", "AXIOM_API_TOKEN", r"\bxaat-[A-Za-z0-9]{32,}\b"),
    ("Azure connection key", "AZURE_STORAGE_CONNECTION_STRING", r"(?:AccountKey|SharedAccessKey)\s*=\s*[A-Za-z0-9+/]{86}=="),
    ("Azure Entra refresh token", "AZURE_REFRESH_TOKEN", r"0\.A[A-Za-z0-9_\-.]{100,}"),
    ("Buildkite agent token", "BUILDKITE_AGENT_TOKEN", r"\b(?:bkua_[a-z0-9]{40}|bkaa_[A-Za-z0-9]{40,})\b"),
    ("Braintree access token", "BRAINTREE_ACCESS_TOKEN", r"\baccess_token\$(?:production|sandbox)\$[0-9a-z]{16}\$[0-9a-f]{32}\b"),
    ("Brevo API key", "BREVO_API_KEY", r"\bxkeysib-[A-Za-z0-9_\-]{50,}\b"),
    ("Checkout.com secret key", "CHECKOUT_SECRET_KEY", r"\bsk_(?:test_)?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("CircleCI personal access token", "CIRCLECI_PERSONAL_ACCESS_TOKEN", r"\bCCIPAT_[a-zA-Z0-9]{22}_[a-fA-F0-9]{40}\b"),
    ("ClickHouse Cloud API key", "CLICKHOUSE_CLOUD_API_SECRET", r"\b4b1d[A-Za-z0-9]{38}\b"),
    ("Clojars deploy token", "CLOJARS_DEPLOY_TOKEN", r"\bCLOJARS_[a-z0-9]{60,}\b"),
    ("Contentful personal access token", "CONTENTFUL_PERSONAL_ACCESS_TOKEN", r"\bCFPAT-[A-Za-z0-9_\-]{40,}\b"),
    ("crates.io API token", "CARGO_REGISTRY_TOKEN", r"\bcio[A-Za-z0-9]{32}\b"),
    ("Databricks API token", "DATABRICKS_TOKEN", r"\bdapi[a-f0-9]{32}\b"),
    ("DigitalOcean token", "DIGITALOCEAN_TOKEN", r"\bdo[opr]_v1_[a-f0-9]{64}\b"),
    ("Discord bot token", "DISCORD_BOT_TOKEN", r"\b[MNO][A-Za-z0-9_\-]{22,25}\.[A-Za-z0-9_\-]{6}\.[A-Za-z0-9_\-]{27,}\b"),
    ("Discord webhook URL", "DISCORD_WEBHOOK_URL", r"https://(?:discord(?:app)?\.com|canary\.discord\.com)/api/webhooks/[0-9]{17,}/[A-Za-z0-9_\-]{60,}"),
    ("Docker personal access token", "DOCKER_PAT", r"\bdckr_pat_[A-Za-z0-9_\-]{20,}\b"),
    ("Doppler token", "DOPPLER_TOKEN", r"dp\.(?:pt|ct|sa|st|pa)\.[A-Za-z0-9]{20,}"),
    ("Dropbox access token", "DROPBOX_ACCESS_TOKEN", r"\b(?:sl\.[A-Za-z0-9\-=_]{135}|[a-z0-9]{11}AAAAAAAAAA[A-Za-z0-9\-_=]{43})"),
    ("Duffel access token", "DUFFEL_ACCESS_TOKEN", r"\bduffel_(?:test|live)_[A-Za-z0-9_\-=]{43}"),
    ("Dynatrace API token", "DYNATRACE_API_TOKEN", r"\bdt0c01\.[A-Za-z0-9]{24}\.[A-Za-z0-9]{64}\b"),
    ("EasyPost API key", "EASYPOST_API_KEY", r"\bEZ(?:AK|TK)[A-Za-z0-9]{54}\b"),
    ("Facebook access token", "FACEBOOK_ACCESS_TOKEN", r"\bEAA[MC][A-Za-z0-9]{100,}\b"),
    ("Facebook example token", "FACEBOOK_ACCESS_TOKEN", r"\bEAACEdEose0cBA[A-Za-z0-9]{8,}\b"),
    ("Figma personal access token", "FIGMA_PERSONAL_ACCESS_TOKEN", r"\bfigd_[A-Za-z0-9_\-]{20,}\b"),
    ("FleetBase API key", "FLEETBASE_API_KEY", r"\bflb_live_[0-9a-zA-Z]{20}\b"),
    ("Flexport API token", "FLEXPORT_API_TOKEN", r"\bshltm_[0-9A-Za-z_\-]{40}\b"),
    ("Flutterwave secret key", "FLW_SECRET_KEY", r"\bFLWSECK(?:_TEST)?-[A-Za-z0-9_\-]{20,}\b"),
    ("Fly.io access token", "FLY_API_TOKEN", r"\bfo1_[A-Za-z0-9_\-]{20,}\b"),
    ("Foursquare API key", "FOURSQUARE_API_KEY", r"\bfsq3[A-Za-z0-9+/_\-]{40,}={0,2}"),
    ("Frame.io token", "FRAMEIO_TOKEN", r"\bfio-u-[A-Za-z0-9\-_=]{64}"),
    ("GitHub token", "GITHUB_TOKEN", r"\b(?:gh[pousr]_[A-Za-z0-9_]{36,}|github_pat_[A-Za-z0-9_]{22,})\b"),
    ("GitLab token", "GITLAB_TOKEN", r"\b(?:gl(?:pat|ptt|rt|soat|dt|cbt|imt|agent|ffct|ft|oas)-[A-Za-z0-9_\-]{20,}|GR1348941[A-Za-z0-9_\-]{20,})\b"),
    ("Google credential", "GOOGLE_API_KEY", r"\b(?:AIza[A-Za-z0-9\-_]{35}|GOCSPX-[A-Za-z0-9\-_]{28})\b"),
    ("Google OAuth access token", "GOOGLE_OAUTH_ACCESS_TOKEN", r"\bya29\.[A-Za-z0-9_\-]{20,}(?:\.[A-Za-z0-9_\-]+)*\b"),
    ("Google Cloud Storage HMAC key ID", "GCS_HMAC_ACCESS_ID", r"\bGOOG1[A-Z0-9]{50,70}\b"),
    ("Grafana token", "GRAFANA_API_KEY", r"\bglsa_[A-Za-z0-9]{32}_[A-Fa-f0-9]{8}\b|glc_[A-Za-z0-9+/\-_]{20,}={0,2}"),
    ("Groq API key", "GROQ_API_KEY", r"\bgsk_[A-Za-z0-9]{48,}\b"),
    ("Harness API key", "HARNESS_API_KEY", r"\b(?:pat|sat)\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9]{24}\.[A-Za-z0-9]{20}\b"),
    ("HashiCorp Vault token", "VAULT_TOKEN", r"\bhv[sbr]\.[A-Za-z0-9_\-]{20,}\b"),
    ("HashiCorp Terraform Cloud token", "TERRAFORM_CLOUD_TOKEN", r"\b[A-Za-z0-9]{14}\.atlasv1\.[A-Za-z0-9\-_=]{60,70}"),
    ("Heroku API key", "HEROKU_API_KEY", r"\bHRKU-[A-Za-z0-9_\-]{30,}\b"),
    ("Honeycomb API key", "HONEYCOMB_API_KEY", r"\bhc(?:aic|acc|xik|xck)_[a-f0-9]{32}\b"),
    ("Hugging Face access token", "HF_TOKEN", r"\bhf_[A-Za-z0-9]{20,}\b"),
    ("Infracost API token", "INFRACOST_API_KEY", r"\bico-[A-Za-z0-9]{20,}\b"),
    ("Instagram access token", "INSTAGRAM_ACCESS_TOKEN", r"\bIGQ[A-Za-z0-9_\-]{100,}\b"),
    ("JSON Web Token", "JWT", r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b"),
    ("LangSmith API token", "LANGSMITH_API_KEY", r"\blsv2_(?:pt|sk)_[a-f0-9]{32,}\b"),
    ("LaunchDarkly SDK key", "LAUNCHDARKLY_SDK_KEY", r"\b(?:sdk|api)-[a-f0-9]{8}-[a-f0-9]{4}-4[a-f0-9]{3}-[a-f0-9]{4}-[a-f0-9]{12}\b"),
    ("Linear API key", "LINEAR_API_KEY", r"\blin_api_[A-Za-z0-9]{30,}\b"),
    ("MaxMind license key", "MAXMIND_LICENSE_KEY", r"\b[A-Za-z0-9]{6}_[A-Za-z0-9]{29}_mmk\b"),
    ("MD5 crypt password hash", "MD5CRYPT_PASSWORD_HASH", r"\$1\$[A-Za-z0-9./]{1,8}\$[A-Za-z0-9./]{22}"),
    ("Microsoft Teams webhook URL", "TEAMS_WEBHOOK_URL", r"https://[a-z0-9]+\.webhook\.office\.com/webhookb2/[a-z0-9]{8}-(?:[a-z0-9]{4}-){3}[a-z0-9]{12}@[a-z0-9]{8}-(?:[a-z0-9]{4}-){3}[a-z0-9]{12}/IncomingWebhook/[a-z0-9]{32}/[a-z0-9]{8}-(?:[a-z0-9]{4}-){3}[a-z0-9]{12}"),
    ("Neon API key", "NEON_API_KEY", r"\bnapi_[A-Za-z0-9_\-]{40,}\b"),
    ("Netlify personal access token", "NETLIFY_AUTH_TOKEN", r"\bnfp_[a-zA-Z0-9_]{36}\b"),
    ("New Relic API key", "NEW_RELIC_API_KEY", r"\bNR(?:AK|II|JS)-[A-Za-z0-9]{20,}\b"),
    ("Notion integration token", "NOTION_API_KEY", r"\bntn_[A-Za-z0-9]{40,}\b"),
    ("NPM access token", "NPM_TOKEN", r"\bnpm_[A-Za-z0-9]{36,}\b"),
    ("NuGet API key", "NUGET_API_KEY", r"\boy2[a-z0-9]{43}\b"),
    ("NVIDIA API key", "NVIDIA_API_KEY", r"\bnvapi-[A-Za-z0-9_\-]{64}\b"),
    ("1Password credential", "OP_SERVICE_ACCOUNT_TOKEN", r"\b(?:A3-[A-Z0-9]{6}-[A-Z0-9]{5,11}(?:-[A-Z0-9]{5}){3}|ops_eyJ[A-Za-z0-9+/\-_]{250,}={0,3})\b"),
    ("OpenAI API key", "OPENAI_API_KEY", r"\b(?:sk-(?:proj|svcacct|admin)-(?:[A-Za-z0-9_\-]{74}|[A-Za-z0-9_\-]{58})T3BlbkFJ(?:[A-Za-z0-9_\-]{74}|[A-Za-z0-9_\-]{58})|sk-[A-Za-z0-9]{20}T3BlbkFJ[A-Za-z0-9]{20})\b"),
    ("OpenRouter API key", "OPENROUTER_API_KEY", r"\bsk-or-v1-[a-f0-9]{64}\b"),
    ("Paddle API key", "PADDLE_API_KEY", r"\bpdl_(?:live|sdbx)_apikey_[a-z0-9]{26}_[A-Za-z0-9]{22}_[A-Za-z0-9]{3}\b"),
    ("Pagar.me API key", "PAGARME_API_KEY", r"\bak_live_[A-Za-z0-9]{30}\b"),
    ("PayPal OAuth access token", "PAYPAL_ACCESS_TOKEN", r"\bA21AA[A-Za-z0-9_\-]{80,}\b"),
    ("Perplexity API key", "PERPLEXITY_API_KEY", r"\bpplx-[A-Za-z0-9]{48}\b"),
    ("Pinecone API key", "PINECONE_API_KEY", r"\bpcsk_[A-Za-z0-9]{5,6}_[A-Za-z0-9]{63}\b"),
    ("PlanetScale token", "PLANETSCALE_TOKEN", r"\bpscale_(?:tkn|oauth|pw)_[A-Za-z0-9_\-]{20,}\b"),
    ("PostHog key", "POSTHOG_PERSONAL_API_KEY", r"\bph[sxar]_[A-Za-z0-9_]{32,}\b"),
    ("Postman API key", "POSTMAN_API_KEY", r"\bPMAK-[A-Za-z0-9\-]{30,}\b"),
    ("PBKDF2 password hash", "PBKDF2_PASSWORD_HASH", r"(?:\$pbkdf2(?:-(?:sha1|sha224|sha256|sha384|sha512))?|pbkdf2_(?:sha1|sha224|sha256|sha384|sha512))\$[0-9]+\$[A-Za-z0-9+/_\-=]+\$[A-Za-z0-9+/_\-=]+"),
    ("Prefect API token", "PREFECT_API_KEY", r"\bpnu_[A-Za-z0-9]{36}\b"),
    ("Pulumi access token", "PULUMI_ACCESS_TOKEN", r"\bpul-[a-f0-9]{40}\b"),
    ("PyPI API token", "PYPI_API_TOKEN", r"\bpypi-[A-Za-z0-9_\-]{50,}\b"),
    ("Ramp API secret", "RAMP_SECRET", r"\bramp_sec_[A-Za-z0-9]{48}\b"),
    ("Razorpay key", "RAZORPAY_KEY_SECRET", r"\brzp_(?:live|test)_[A-Za-z0-9]{14,}\b"),
    ("ReadMe API token", "README_API_KEY", r"\brdme_[a-z0-9]{70}\b"),
    ("Render API key", "RENDER_API_KEY", r"\brnd_[A-Za-z0-9]{40,}\b"),
    ("Replicate API token", "REPLICATE_API_TOKEN", r"\br8_[A-Za-z0-9]{20,}\b"),
    ("Resend API key", "RESEND_API_KEY", r"\bre_[A-Za-z0-9_]{32,}\b"),
    ("Robinhood Crypto API key", "ROBINHOOD_API_KEY", r"\brh-api-[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("Rootly API key", "ROOTLY_API_KEY", r"\brootly_[a-f0-9]{64}\b"),
    ("RubyGems API key", "RUBYGEMS_API_KEY", r"\brubygems_[a-f0-9]{48}\b"),
    ("SaladCloud API key", "SALAD_API_KEY", r"\bsalad_cloud_[0-9A-Za-z]{1,7}_[0-9A-Za-z]{7,235}\b"),
    ("Scalingo API token", "SCALINGO_API_TOKEN", r"\btk-us-[A-Za-z0-9_\-]{48}\b"),
    ("scrypt password hash", "SCRYPT_PASSWORD_HASH", r"\$scrypt\$ln=[0-9]+,r=[0-9]+,p=[0-9]+\$[A-Za-z0-9+/=]+\$[A-Za-z0-9+/=]+"),
    ("SendGrid API key", "SENDGRID_API_KEY", r"SG\.[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{20,}"),
    ("Sentry auth token", "SENTRY_AUTH_TOKEN", r"\bsntry[su]_[A-Za-z0-9]{20,}\b"),
    ("Sentry DSN", "SENTRY_DSN", r"\bhttps://[a-f0-9]{32}(?::[a-f0-9]{32})?@[A-Za-z0-9.\-]+\.ingest(?:\.[a-z]{2})?\.sentry\.io/[0-9]+\b"),
    ("SettleMint access token", "SETTLEMINT_ACCESS_TOKEN", r"\bsm_(?:pat|aat|sat)_[A-Za-z0-9]{16}\b"),
    ("SHA-256 crypt password hash", "SHA256CRYPT_PASSWORD_HASH", r"\$5\$(?:rounds=[0-9]+\$)?[A-Za-z0-9./]{1,16}\$[A-Za-z0-9./]{43}"),
    ("SHA-512 crypt password hash", "SHA512CRYPT_PASSWORD_HASH", r"\$6\$(?:rounds=[0-9]+\$)?[A-Za-z0-9./]{1,16}\$[A-Za-z0-9./]{86}"),
    ("Shippo API token", "SHIPPO_API_TOKEN", r"\bshippo_(?:live|test)_[a-fA-F0-9]{40}\b"),
    ("Shopify access token", "SHOPIFY_ACCESS_TOKEN", r"\bshp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32,}\b"),
    ("Slack token", "SLACK_BOT_TOKEN", r"\b(?:xox[bpare]|xapp)-[A-Za-z0-9\-]{20,}\b"),
    ("Slack webhook URL", "SLACK_WEBHOOK_URL", r"https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{20,}"),
    ("Sourcegraph Cody API key", "SOURCEGRAPH_CODY_API_KEY", r"\bslk_[a-f0-9]{64}\b"),
    ("Square access token", "SQUARE_ACCESS_TOKEN", r"\b(?:EAAA|sq0atp-|sq0csp-)[A-Za-z0-9_\-+=]{22,60}\b"),
    ("SonarQube/SonarCloud token", "SONAR_TOKEN", r"\bsq[aup]_[a-f0-9]{40}\b"),
    ("Sourcegraph access token", "SRC_ACCESS_TOKEN", r"\bsg[psd]_[A-Za-z0-9_]{16,}\b"),
    ("Stripe secret key", "STRIPE_SECRET_KEY", r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{20,}\b"),
    ("Stripe publishable key", "STRIPE_PUBLISHABLE_KEY", r"\bpk_(?:live|test)_[A-Za-z0-9]{20,}\b"),
    ("Stripe webhook signing secret", "STRIPE_WEBHOOK_SECRET", r"\bwhsec_[A-Za-z0-9]{32,}\b"),
    ("Supabase service token", "SUPABASE_SERVICE_ROLE_KEY", r"\b(?:sbp_[a-f0-9]{40}|sb_secret_[A-Za-z0-9_\-]{20,})\b"),
    ("Supabase publishable key", "SUPABASE_PUBLISHABLE_KEY", r"\bsb_publishable_[A-Za-z0-9_\-]{20,}\b"),
    ("Tailscale key", "TAILSCALE_AUTHKEY", r"\btskey-(?:auth|api|scim)-[A-Za-z0-9_\-]{20,}\b"),
    ("Telegram bot token", "TELEGRAM_BOT_TOKEN", r"\b[0-9]{8,10}:[A-Za-z0-9_\-]{35}\b"),
    ("Tencent Cloud SecretId", "TENCENTCLOUD_SECRET_ID", r"\bAKID[A-Za-z0-9]{32}\b"),
    ("Twilio Account SID", "TWILIO_ACCOUNT_SID", r"\b(?:AC|SK)[0-9a-fA-F]{32}\b"),
    ("Typeform personal access token", "TYPEFORM_PERSONAL_ACCESS_TOKEN", r"\btfp_[A-Za-z0-9_\-]{30,}\b"),
    ("Ubidots API token", "UBIDOTS_API_TOKEN", r"\bBBFF-[0-9a-zA-Z]{30}\b"),
    ("Vercel access token", "VERCEL_TOKEN", r"\bvc[piarks]_[A-Za-z0-9]{40,}\b"),
    ("WakaTime API key", "WAKATIME_API_KEY", r"\bwaka_[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    ("xAI API key", "XAI_API_KEY", r"\bxai-[0-9A-Za-z_]{80}\b"),
    ("Xata API key", "XATA_API_KEY", r"\bxau_[A-Za-z0-9]{20,}\b"),
    ("Yandex Cloud IAM token", "YC_TOKEN", r"\bAQVN[A-Za-z0-9_\-]{35,38}\b"),
    ("yescrypt password hash", "YESCRYPT_PASSWORD_HASH", r"\$y\$[A-Za-z0-9./]+\$[A-Za-z0-9./]+\$[A-Za-z0-9./]{20,}"),
)

_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"\b", _BOUNDARY)


def _literals(tree) -> list[frozenset[str]]:
    """Sets of literals of which every match of a parsed pattern holds one."""
    found, run = [], ""
    for op, arg in [*tree, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if run:
            found, run = [*found, frozenset([run])], ""
        if name == "SUBPATTERN":
            found += _literals(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found += _literals(arg[2])
        elif name == "BRANCH":
            best = [_best(_literals(branch)) for branch in arg[1]]
            found += [frozenset().union(*best)] if all(best) else []
    return found


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def required(pattern: str) -> frozenset[str]:
    """Literals of which every match of the pattern holds one; empty where there are none."""
    return _best(_literals(re._parser.parse(pattern, re.ASCII)))


class Matcher:
    """All hits of the catalogue in a text: patterns run only where one of their literals occurs."""

    def __init__(self):
        import ahocorasick

        self.compiled = [re.compile(p, re.ASCII) for _, _, p in SIGNATURES]
        self.always, by_literal = [], {}
        for i, (_, _, pattern) in enumerate(SIGNATURES):
            for literal in required(pattern):
                by_literal.setdefault(literal, []).append(i)
            if not required(pattern):
                self.always.append(i)
        self.literals = ahocorasick.Automaton()
        for literal, owners in by_literal.items():
            self.literals.add_word(literal, tuple(owners))
        self.literals.make_automaton()

    def candidates(self, text: str) -> list[int]:
        return sorted({*self.always, *(i for _, owners in self.literals.iter(text) for i in owners)})

    def first(self, text: str) -> int | None:
        """The first signature, in catalogue order, that matches anywhere."""
        return next((i for i in self.candidates(text) if self.compiled[i].search(text)), None)

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, ordinal) without overlaps: by start, then the shorter; a hit that begins inside a taken one is dropped."""
        taken, covered = [], 0
        for start, end, ordinal in sorted((m.start(), m.end(), i) for i in self.candidates(text) for m in self.compiled[i].finditer(text)):
            if start >= covered:
                taken.append((start, end, ordinal))
                covered = end
        return taken


@lru_cache(maxsize=1)
def matcher() -> Matcher:
    return Matcher()


def catalogue(spark: SparkSession) -> DataFrame:
    """(ordinal, name, env_var, pattern, kind), a fixed small relation."""
    kind = lambda name: "public" if name in PUBLIC else "placeholder" if name in PLACEHOLDER else "secret"
    rows = [(i, name, env, pattern, kind(name)) for i, (name, env, pattern) in enumerate(SIGNATURES)]
    return spark.createDataFrame(rows, "ordinal int, name string, env_var string, pattern string, kind string")
